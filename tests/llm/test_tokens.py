import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnspark.llm import packing, tokens

from . import cases

SF = "/root/testdata/sf0.001"


def ids(text):
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids


def check_counts(docs):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(map(tuple, tokens.token_counts(docs).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(encode.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def check_packing(docs):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    waste = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
        waste += 0 if at & (at - 1) == 0 else 4096 - at
    assert waste == 0
    left = [(r.doc_id, encode.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.select("doc_id", "text").collect()]
    assert sum(r.length for r in rows) == sum(len(x) for _, x in left)
    want = {(d, len(x)): x for d, x in left}
    for r in rows:
        x = np.array(want[r.doc_id, r.doc_tokens][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(x) == r.ids_crc32 and len(x) == 4 * r.length
    return rows


def test_counts_are_the_library_s(spark):
    check_counts(spark.read.parquet(f"{SF}/documents.parquet"))


def test_counts_of_odd_rows(spark):
    check_counts(cases.frame(spark))
    assert tokens.token_counts(cases.empty(spark)).count() == 0


def test_packing_is_whole_and_without_padding(spark):
    check_packing(spark.read.parquet(f"{SF}/documents.parquet"))


def test_packing_of_odd_rows(spark):
    check_packing(cases.frame(spark))
    assert packing.pack_documents(cases.empty(spark)).count() == 0


def test_classes_hold_a_fixed_count():
    pieces = packing.pack_block([1300] * 30 + [900] * 8 + [10] * 400)
    first = [p for p in pieces if p[3] == 0]
    assert sum(p[2] for p in first) == 4096 and sum(p[2] == 1300 for p in first) == 3


def test_the_cache_holds_pre_tokens_only():
    """Words that differ in their punctuation are no entries of their own; the ids are the library's."""
    path = tokens.default_path()
    cache = tokens.PieceCache(path, tokens.bytes_of, b"".join)
    texts = ["Stone. stone, (stone) stone's 12stone3 isn't", "stone!! 'REally' o'll'd ½stoneß", ""]
    assert [np.frombuffer(b, "<u4").tolist() for b in cache.texts(texts)] == [ids(t) for t in texts]
    assert {"stone", ".", "'s", "1"} <= cache.known.keys() and not {"stone.", "stone's", "12stone3"} & cache.known.keys()
