"""Language of code-switched text by a linear-chain conditional random field over words.

A word's emission scores come from hashed affix, character n-gram and lexicon features; transitions
between labels are learned with them. The forward-backward algorithm gives each word's label
probabilities; a text's language is the label with the largest sum over all its words.

The model is fitted on the driver from a bounded sample: at most ``DOCS_PER_LABEL`` labelled documents of
each language and about ``DOCS`` in all, but one of each at least, ``WORDS_PER_DOC`` consecutive words of each.
Training sequences switch between documents of different languages. Prediction is map-only over whole texts.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

DOCS_PER_LABEL = 300
WORDS_PER_DOC = 400
DOCS = 20_000
UNKNOWN = "und"
FEATURES = 1 << 16
SEQUENCES, SEQUENCE_WORDS, STEPS = 3000, 24, 40
#: The counts of so many languages are sent to all executors; those of more are joined by shuffling.
SMALL_TABLE = 10_000
#: A worker labels so many documents or characters together, and keeps the scores of so many words.
BATCH_DOCS, BATCH_CHARS, CACHE = 2048, 2 << 20, 250_000
#: Words whose features are looked up together.
FRESH = 4096

#: Letters, but also numerals that aren't decimal digits, which part words as well.
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():
        found = ["".join(run) for word in found for letters, run in groupby(word, str.isalpha) if letters]
    return found


def features(word: str) -> list[int]:
    """Hashed ids of the lexicon, affix and n-gram features of a word."""
    w = f"^{word}$"
    found = [f"={w}"]
    found += [w[: k + 1] for k in (1, 2, 3)] + [w[-k - 1 :] for k in (1, 2, 3, 4)]
    found += [f"2{w[i : i + 2]}" for i in range(len(w) - 1)] + [f"3{w[i : i + 3]}" for i in range(len(w) - 2)]
    return [zlib.crc32(x.encode()) & (FEATURES - 1) for x in found]


def emissions(vocabulary: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(vocabulary), weights.shape[1]), weights.dtype)
    for at in range(0, len(vocabulary), FRESH):
        rows = [features(w) for w in vocabulary[at : at + FRESH]]
        starts = np.cumsum([0, *map(len, rows[:-1])])
        out[at : at + FRESH] = np.add.reduceat(weights[np.concatenate(rows)], starts, axis=0)
    return out


def marginal_sums(ids: np.ndarray, lengths: np.ndarray, scores: np.ndarray, transition: np.ndarray, each: bool = False):
    """Sums over a sequence of its words' label probabilities, for sequences of ``lengths`` words laid end to end.

    With ``each``: the probabilities of every word, and the expected transition counts, instead.
    The recursions run over positions; at each one they take all sequences that are long enough at once.
    """
    order = np.argsort(-lengths, kind="stable")
    n, labels = lengths[order], scores.shape[1]
    top = int(n[0]) if len(n) else 0
    active = len(n) - np.searchsorted(n[::-1], np.arange(top), side="right")  # sequences with a word at the position
    at = np.concatenate([[0], np.cumsum(active)])
    begins = np.cumsum(lengths) - lengths
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    position = np.arange(len(ids)) - np.repeat(begins, lengths)
    slot = at[position] + np.repeat(rank, lengths)
    emit = np.empty((len(ids), labels), scores.dtype)
    emit[slot] = np.exp(scores[ids] - scores[ids].max(axis=1, keepdims=True))
    move = np.exp(transition).astype(scores.dtype)
    ahead = np.empty_like(emit)
    for t in range(top):
        now = emit[at[t] : at[t + 1]]
        if t:
            now = now * (ahead[at[t - 1] : at[t - 1] + active[t]] @ move)
        ahead[at[t] : at[t + 1]] = now / now.sum(axis=1, keepdims=True)
    sums = np.zeros((len(n), labels))
    pairs = np.zeros((labels, labels))
    shares = np.empty_like(emit) if each else None
    behind = np.ones((len(n), labels), scores.dtype)
    for t in range(top - 1, -1, -1):
        k = active[t]
        if t + 1 < top and active[t + 1]:
            m = active[t + 1]
            back = emit[at[t + 1] : at[t + 2]] * behind[:m]
            if each:
                here = ahead[at[t] : at[t] + m]
                pairs += move * ((here / ((here @ move) * back).sum(axis=1, keepdims=True)).T @ back)
            back = back @ move.T
            behind[:m] = back / back.sum(axis=1, keepdims=True)
        share = ahead[at[t] : at[t + 1]] * behind[:k]
        share /= share.sum(axis=1, keepdims=True)
        sums[:k] += share
        if each:
            shares[at[t] : at[t + 1]] = share
    if each:
        return shares[slot], pairs
    out = np.empty_like(sums)
    out[order] = sums
    return out


def fit(texts: list[list[str]], labels: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, emission weights and transition weights by Adam on the conditional log-likelihood."""
    names = sorted(set(labels))
    if not names:
        return [], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0), np.float32)
    rng = np.random.default_rng(seed)
    pools = [[t for t, y in zip(texts, labels, strict=True) if y == name] for name in names]
    sequences, gold = [], []
    for _ in range(max(SEQUENCES, 40 * len(names))):
        seq, tags = [], []
        while len(seq) < SEQUENCE_WORDS:
            y = int(rng.integers(len(names)))
            text = pools[y][int(rng.integers(len(pools[y])))]
            run = min(int(rng.geometric(1 / 8)), SEQUENCE_WORDS - len(seq))
            start = int(rng.integers(max(1, len(text) - run + 1)))
            part = text[start : start + run]
            seq += part
            tags += [y] * len(part)
        sequences.append(seq)
        gold.append(tags)
    vocabulary = sorted({w for s in sequences for w in s})
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([number[w] for s in sequences for w in s])
    tags = np.array([y for s in gold for y in s])
    lengths = np.array([len(s) for s in sequences])
    rows = [features(w) for w in vocabulary]
    owner, flat, k = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), len(names)
    starts = np.cumsum([0, *map(len, rows[:-1])])
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - 1] = False
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (tags[:-1][inner[:-1]], tags[1:][inner[:-1]]), 1)
    weights, moves = np.zeros((FEATURES, k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        scores = np.add.reduceat(weights[flat], starts, axis=0)
        share, pairs = marginal_sums(ids, lengths, scores, moves, each=True)
        share[np.arange(len(ids)), tags] -= 1
        by_word = np.stack([np.bincount(ids, share[:, y], len(vocabulary)) for y in range(k)], axis=1)
        slope = np.stack([np.bincount(flat, by_word[owner, y], FEATURES) for y in range(k)], axis=1)
        slope = slope / len(ids) + 1e-6 * weights
        slope_moves = (pairs - seen_pairs) / len(ids) + 1e-4 * moves
        for value, grad, m, v in ((weights, slope, state[0], state[1]), (moves, slope_moves, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return names, weights.astype(np.float32), moves.astype(np.float32)


def _sample(docs: DataFrame) -> pd.DataFrame:
    """At most DOCS_PER_LABEL rows (lang, words) of each language, chosen by a hash of doc_id. The languages of a corpus are few."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    counts = known.groupBy("lang").agg(F.count("*").alias("known"))
    labels = counts.count()
    each = max(1, min(DOCS_PER_LABEL, DOCS // max(1, labels)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    nearest = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    # a large language is thinned before it is sorted, to some times what is wanted of it
    counts = F.broadcast(counts) if labels <= SMALL_TABLE else counts
    thinned = known.select("doc_id", "lang", "text", place.alias("place")).join(counts, "lang").where(F.col("place") * F.col("known") < 3 * each + 30)
    chosen = thinned.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= each)

    def shorten(batches):
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found = words(text)
                at = zlib.crc32(text.encode()) % max(1, len(found) - WORDS_PER_DOC + 1)
                rows.append((lang, " ".join(found[at : at + WORDS_PER_DOC])))
            yield pd.DataFrame(rows, columns=["lang", "words"])

    return chosen.select("lang", "text").mapInPandas(shorten, "lang string, words string").toPandas().sort_values(["lang", "words"])


def _model(docs: DataFrame):
    sample = _sample(lean(docs).select("doc_id", "text", "lang"))
    split = [w.split() for w in sample["words"]]
    known = [(w, y) for w, y in zip(split, sample["lang"], strict=True) if w]
    return docs.sparkSession.sparkContext.broadcast(fit([w for w, _ in known], [y for _, y in known]))


class Labeller:
    """A fitted model with the scores of the words that it has met."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(names)), np.float32)

    def label(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of texts given by their words."""
        new = set().union(*found) - self.number.keys()
        if len(self.number) + len(new) > CACHE:
            self.number, self.scores, new = {}, self.scores[:0], set().union(*found)
        fresh = list(new)
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
        self.scores = np.concatenate([self.scores, emissions(fresh, self.weights)])
        lengths = np.array([len(x) for x in found], np.int64)
        lang, score = np.full(len(found), UNKNOWN, object), np.zeros(len(found))
        some = np.flatnonzero(lengths)
        if self.names and len(some):
            flat = np.fromiter((self.number[w] for x in found for w in x), np.int64, int(lengths.sum()))
            sums = marginal_sums(flat, lengths[some], self.scores, self.moves)
            best = sums.argmax(axis=1)
            lang[some] = np.array(self.names, object)[best]
            score[some] = np.clip(sums[np.arange(len(some)), best] / lengths[some], 0, 1)
        return lang, score

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of whole texts, by batches of bounded size."""
        langs, scores, found, size = [], [], [], 0
        for text in [*texts, None]:
            found.append(words(text))
            size += len(text or "")
            if len(found) >= BATCH_DOCS or size >= BATCH_CHARS:
                lang, score = self.label(found)
                langs.append(lang)
                scores.append(score)
                found, size = [], 0
        if found:
            lang, score = self.label(found)
            langs.append(lang)
            scores.append(score)
        return np.concatenate(langs)[:-1], np.concatenate(scores)[:-1]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Documents whose crc32(doc_id as text) mod 3 is 1 are held out: they are never learned from. A text that
    is null or has no letter gives ``und`` with score 0, as does every text if nothing is labelled. A null
    doc_id is not held out and not learned from. Repeated rows stay repeated; other columns are ignored.
    """
    model = _model(docs)

    def run(batches):
        labeller = Labeller(*model.value)
        for batch in batches:
            lang, score = labeller.texts(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "lang_pred": lang, "score": score})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, lang_pred string, score double")
    held = F.coalesce(F.crc32("doc_id") % 3 == 1, F.lit(False))
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, least: float) -> DataFrame:
    """The documents, with all their columns, whose text has a language with a score of ``least`` or more.

    If nothing is labelled, no document can be told and all whose text has a letter stay.
    """
    model = _model(docs)

    def run(batches):
        labeller = Labeller(*model.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang, score = labeller.texts(texts)
            keep = (lang != UNKNOWN) & (score >= least) if labeller.names else np.array([bool(words(t)) for t in texts], bool)
            yield batch.filter(pa.array(keep.tolist(), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
