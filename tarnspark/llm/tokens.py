"""Token counts and ids of whole texts, as a public word-level BPE tokenizer gives them.

Counting is map-only. A compact table with the token lengths of frequent pre-tokens is broadcast;
what it lacks is encoded by the library, once for each distinct pre-token, and kept in a bounded cache of
the Python worker. No pre-token is ever shuffled.

Pre-tokens are found with a plain regular expression only in texts made of the characters for which
this expression and the library's normaliser and splitter agree by inspection (printable Latin-1 and
common white space, no special token strings). Any other text goes through the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: The frequent tier is counted on so many documents at most, and holds so many pre-tokens at most.
SAMPLE_DOCUMENTS = 2000
FREQUENT = 40_000
#: Entries of a generation of a worker's cache; it holds two, and the older one goes when the newer is full.
CACHE = 250_000

_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]|<\|")
_PIECES = re.compile(r"[a-zªµºß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_loaded: dict[str, object] = {}
_ends: dict[str, np.ndarray] = {}
_caches: dict[tuple, PieceCache] = {}


def tokenizer(path: str):
    """One tokenizer for each worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens of a plain text; None if the library has to split it. They are far fewer than words with their punctuation."""
    return None if _OTHER.search(text) else _PIECES.findall(text.lower())


def lengths_of(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    return np.diff(ends, prepend=0).tolist()


def bytes_of(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    whole, at = ids.tobytes(), [0, *(4 * ends).tolist()]
    return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]


def encode_pieces(path: str, pieces: list[str], values) -> Iterator[object]:
    """What ``values`` makes of each pre-token's ids.

    Many go to the library as one text, parted by blanks; a token that ends a pre-token tells where each ends.
    """
    if path not in _ends:
        vocabulary = tokenizer(path).get_vocab()
        _ends[path] = np.zeros(max(vocabulary.values()) + 1, bool)
        _ends[path][[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    at = range(0, len(pieces), 500)
    for k, e in zip(at, tokenizer(path).encode_batch_fast([" ".join(pieces[k : k + 500]) for k in at], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(_ends[path][ids]) + 1
        if len(ends) != len(pieces[k : k + 500]):
            raise ValueError("the tokenizer has no end of word tokens")
        yield from values(ids, ends)


class PieceCache:
    """Values of the pre-tokens met so far; ``join`` adds up those of a text."""

    def __init__(self, path: str, values, join, known: dict | None = None):
        self.path, self.values, self.join = path, values, join
        self.known, self.before = {}, dict(known or {})

    def learn(self, split: list[list[str] | None]) -> None:
        met = set().union(*(pieces for pieces in split if pieces is not None))
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            # the pre-tokens of these texts move to the new generation, the one before the last goes
            self.known, self.before, fresh = {}, self.known, met
        again = self.before.keys() & fresh
        self.known.update((piece, self.before[piece]) for piece in again)
        missing = list(fresh - again)
        self.known.update(zip(missing, encode_pieces(self.path, missing, self.values), strict=True))

    def texts(self, texts: list[str]) -> Iterator[object]:
        """The joined value of each text, in order."""
        split = [pre_tokens(t) for t in texts]
        self.learn(split)
        of = self.known.__getitem__
        for text, pieces in zip(texts, split, strict=True):
            if pieces is not None:
                yield self.join(map(of, pieces))
            else:
                ids = np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4")
                yield self.values(ids, np.array([len(ids)]))[0]


def worker_cache(path: str, values, join, known: dict | None = None) -> PieceCache:
    """The worker's cache; tasks that it runs one after another share it."""
    key = (path, values.__name__)
    if key not in _caches:
        _caches[key] = PieceCache(path, values, join, known)
    return _caches[key]


def _frequent(docs: DataFrame, path: str) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of a bounded sample; a cache, so results don't depend on it."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(pre_tokens(text) or ())
        words = [w for w, _ in seen.most_common(FREQUENT)]
        yield pd.DataFrame({"piece": words, "n": list(encode_pieces(path, words, lengths_of))})

    every = max(1, docs.count() // (2 * SAMPLE_DOCUMENTS))
    sample = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("text").limit(SAMPLE_DOCUMENTS).coalesce(1)
    return {r["piece"]: r["n"] for r in sample.mapInPandas(count, "piece string, n long").collect()}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated rows stay repeated;
    an empty table gives an empty result. Other columns are ignored.
    """
    path = path or default_path()
    docs = lean(docs).select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(_frequent(docs, path))

    def run(batches):
        cache = worker_cache(path, lengths_of, sum, table.value)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].fillna("").tolist()
            for at in range(0, len(texts), 1000):
                part = texts[at : at + 1000]
                yield pd.DataFrame({"doc_id": ids.iloc[at : at + 1000].to_numpy(), "n_bytes": [len(t.encode()) for t in part], "n_tokens": list(cache.texts(part))})

    # doc_id passes through pandas; as text, null ids and large ids keep their value
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
