"""Mixing against its rules, fingerprints against a plain walk, and the pipeline on whole small tables."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnspark.llm import edit_embedding, mixing, registry

from . import cases

D = "/root/testdata/sf0.001"


def fill(sizes):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s] + 1e-9}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and len(r.shards) == -(-r.taken // r.size) if r.size else r.taken == 0
    want = fill(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    return rows


def test_mix(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = check_mix(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) for r in rows)
    draws = sum(len(r.shards) for r in rows)
    per = [sum(x == k for r in rows for x in r.shards) for k in range(8)]
    assert sum(per) == draws and min(per) > 0
    clash = docs.withColumns({c: F.lit(5) for c in ("_id", "_draws", "taken", "key", "turn", "shard", "at", "size")})
    out = mixing.apply(clash)
    assert out.columns == clash.columns and {r.key for r in out.collect()} == {5}
    out = mixing.apply(docs)
    found, weighed = out.collect(), {r.doc_id: r for r in rows}
    for source in {r.source for r in rows}:
        target = next(r.target for r in rows if r.source == source)
        assert abs(sum(weighed[r.doc_id].size for r in found if r.source == source) - target) <= max(r.size for r in rows if r.source == source)
    assert out.columns == docs.columns and abs(out.count() - 1.5 * len(rows)) < 0.3 * len(rows)


def test_mix_of_odd_rows(spark):
    check_mix(cases.frame(spark))
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.apply(cases.empty(spark)).count() == 0


def test_split_is_exact(spark):
    quotas = spark.createDataFrame([(0, 13), (1, 0), (2, 40), (3, 1)], "nth long, n long")
    rows = mixing.split(quotas, 3).collect()
    assert {k: sum(r.n for r in rows if r.nth == k) for k in (0, 2, 3)} == {0: 13, 2: 40, 3: 1}
    assert sorted(sum(r.n for r in rows if r.shard == k) for k in range(8)) == [6, 6, 7, 7, 7, 7, 7, 7]


def test_split_is_hypergeometric(spark):
    """Over many seeds a source's share of a half has the mean and the variance of draws without replacement."""
    quotas = spark.createDataFrame([(0, 12), (1, 28)], "nth long, n long")
    left = [{r.nth: r.n for r in mixing.split(quotas, 1, seed).where("shard = 0").collect()}.get(0, 0) for seed in range(24)]
    # 20 of 40 blocks, 12 of them of the source: mean 6, variance 20 * 0.3 * 0.7 * 20 / 39 = 2.15
    assert abs(sum(left) / 24 - 6) < 1.0 and 0.7 < sum((x - 6) ** 2 for x in left) / 24 < 4.5


def plain_walk(text):
    level, codes = edit_embedding._level(len(text)), [*edit_embedding._symbols(text), 0]
    levels = edit_embedding.step_levels(0, max(1, 3 * len(text)))
    at, out = 0, []
    for j in range(3 * len(text)):
        if levels[j] >= level:
            out.append(int(codes[at]))
        at += int(edit_embedding._MOVES[int(edit_embedding._TURN[j & 0xFFFF]) ^ ((j >> 16) & 4095), codes[at]])
    return level, bytes(out).rstrip(b"\0")


def check_prints(docs):
    rows = [(d, t or "") for d, t in sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]  # one row at most has no doc_id
    got = edit_embedding.fingerprints(docs).collect()
    want = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, b, c = map(plain_walk, (text, edited, after))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), edit_embedding.to_string(a), edit_embedding.to_string(b), edit_embedding.likeness(a, b), edit_embedding.likeness(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


def test_prints(spark):
    got = check_prints(spark.read.parquet(f"{D}/documents.parquet"))
    assert sum(r.near_edited > r.near_next for r in got) >= 0.99 * len(got)


def test_prints_of_odd_rows(spark):
    check_prints(cases.frame(spark))
    assert edit_embedding.fingerprints(cases.empty(spark)).count() == 0


def test_rows_without_id_follow_each_other_by_hash(spark):
    rows = [(1, "first " * 9)] + [(None, f"text number {i} " * 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.text for r in docs.orderBy(F.col("doc_id").isNull(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).collect()]
    want = sorted(hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in edit_embedding.fingerprints(docs).collect()) == want


def test_one_long_text_walks_alone():
    text = "ab cd efg " * 4000 + "\U0001f600\0" + "xyz " * 3000
    found = edit_embedding.embed([text, "short", text[:-1], ""])
    assert [found[0], found[1], found[2]] == [plain_walk(t) for t in (text, "short", text[:-1])]


def test_near_groups(spark):
    """Recall of copies with a few edits, on both sides of a level's bound, and no links between unlike texts."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    rows, edited = [], 0
    for g in range(60):
        text = "".join(rng.choices(letters, k=rng.choice([60, 300, 1020, 1024, 2040, 5000])))
        rows.append((10 * g, text))
        for k in (1, 2):
            copy = list(text)
            for _ in range(max(1, len(text) // 400)):
                at = rng.randrange(len(copy) // 2, len(copy))
                rng.choice([lambda at=at: copy.insert(at, "q"), lambda at=at: copy.pop(at), lambda at=at: copy.__setitem__(at, "z")])()
            rows.append((10 * g + k, "".join(copy)))
            edited += 1
    rows += [(5000 + i, "the same beginning of all " * 3 + "".join(rng.choices(letters, k=900))) for i in range(40)] + [(None, "x"), (7001, None), (7002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in edit_embedding.near_groups(docs).collect()}
    assert sum(got[10 * g + k] == 10 * g for g in range(60) for k in (1, 2)) >= 0.9 * edited
    assert all(got[5000 + i] == 5000 + i for i in range(40)) and got[None] is None and got[7002] == 7001
    assert edit_embedding.near_groups(cases.frame(spark)).count() == 13 and edit_embedding.near_groups(cases.empty(spark)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
    assert set(registry.pipeline(spark, D).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    docs = cases.frame(spark)
    for make in (cases.frame, cases.empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, make(spark), D).count()
    assert docs.count() == 13
