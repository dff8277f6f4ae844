import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tarnspark.llm import resampling

from . import cases


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, share=5):
    """(doc_id, n_features, weight, score, rank) of every document, in one process."""
    own, wanted = Counter(), Counter()
    for _, text in docs:
        own.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    S, T = sum(own.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (S + 10_000) / ((s + 1) * (T + 10_000)))) for b, s in own.items()}
    rows = []
    for doc, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: share * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def order(r):
    return tuple((x is None, x or 0) for x in r)


def test_words_are_those_of_the_expression(spark):
    texts = ["", None, "A-b c", "ÀÉ İK ΑΣ Ⓐx", "x\x00y\x7fz", "  lead trail  ", "it's 12½ n", "\U0001f600A漢字"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(resampling.words(F.col("text")).alias("w")).collect()
    assert [r["w"] for r in found] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]


def test_rows_against_one_process(spark):
    rows = cases.rows()
    rows += [(1000 + i // 2, f"Alpha beta {i % 7} gamma " * (i % 9 + 3) + f"tail {i}", None, None, None, None, None) for i in range(300)]
    rows += [rows[-1]] * 3 + [(None, "same words again " * 10, None, None, None, None, None)] * 2
    target = ["Alpha beta 3 gamma tail", None, "the quick brown fox", ""]
    found = resampling.resample(cases.frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 5
    assert sorted(map(tuple, found.collect()), key=order) == sorted(plain([r[:2] for r in rows], target), key=order)


def test_ranks_over_many_ranges_and_copies(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE", 20)
    monkeypatch.setattr(resampling, "COPIES", 7)
    text = "one two three four five " * 5
    rows = [(5, text, None, None, None, None, None)] * 60 + [(i, f"{text} {i}", None, None, None, None, None) for i in range(100, 200)]
    found = resampling.resample(cases.frame(spark, rows), spark.createDataFrame([(text,)], "text string"), share=90)
    drawn = [r for r in found.collect() if r["rank"]]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 145))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(plain([r[:2] for r in rows], [text], 90), key=order)


def test_no_documents_or_no_target(spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(cases.empty(spark), target).collect() == []
    found = resampling.resample(cases.frame(spark), target)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(plain([r[:2] for r in cases.rows()], []), key=order)
