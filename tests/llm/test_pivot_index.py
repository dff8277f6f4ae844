import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.llm import pivot_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k=10, every=1):
    """{query: [(score, vec_id)]} by comparing all."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in sound:
        if q % every == 0:
            best = out.setdefault(q, {})
            for i, y in sound:
                if i != q and len(x) == len(y):
                    d = float(np.sqrt(((x - y) ** 2).sum()))
                    best[i] = min(d, best.get(i, np.inf))
    return {q: sorted((d, i) for i, d in b.items())[:k] for q, b in out.items() if b}


def found(spark, rows, every=1, k=10):
    out = {}
    for r in pivot_index.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_few_rows_are_answered_in_full(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(30)]
    rows += [(30, None, 0), (31, [], 0), (32, [0.0] * 3, 0), (33, [1.0, None, 2.0], 0), (34, [1.0, float("nan"), 2.0], 0), (35, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    rows += [(40, [1.0, 2.0], 0), (41, [2.0, 1.0], 0), (42, [7.0] * 5, 0)]
    rows += [(50, rows[0][1], 0), (51, rows[0][1], 0), (0, rows[0][1], 1), (3, [9.0, 9.0, 9.0], 0), (60, [-0.0, 1.0, 0.0], 0), (61, [0.0, 1.0, -0.0], 0)]
    got, want = found(spark, rows), exact(rows)
    # footrule bounds may leave out some of the farther ones, never the number
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert got[60][0] == (0.0, 61) and got[51][:2] == [(0.0, 0), (0.0, 50)] and got[40] == [(pytest.approx(2**0.5), 41)]
    assert 42 not in got
    same = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert same >= 0.9 * sum(map(len, want.values()))


def test_copies_give_their_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "IDS", 50)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(400)] + [(1000 + i, [float(i), 1.0, 0.5], 0) for i in range(1, 30)]
    got = found(spark, rows)
    assert got[399] == [(0.0, i) for i in range(10)]
    assert got[4] == [(0.0, i) for i in (0, 1, 2, 3, 5, 6, 7, 8, 9, 10)]


def test_recall_and_scores_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "SHARD", 300)
    monkeypatch.setattr(pivot_index, "BLOCK", 200)
    monkeypatch.setattr(pivot_index, "QUERIES", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    # a third of all rows are near copies of one vector
    x = np.concatenate([centres[rng.integers(0, 20, 2000)] + 0.5 * rng.normal(size=(2000, 24)), centres[:1] + 0.01 * rng.normal(size=(1000, 24))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    got, want = found(spark, rows, every=20), exact(rows, every=20)
    assert set(got) == set(want)
    true = {q: dict((i, d) for d, i in exact([rows[q], *[rows[i] for _, i in got[q]]], every=20)[q]) for q in list(got)[:10]}
    assert all(d == true[q][i] for q in true for d, i in got[q])
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_bounds_that_find_nothing_are_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "_bounds", lambda trial, shards: (dict.fromkeys(shards, 1), dict.fromkeys(shards, 1 << 30)))
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(60)]
    got, want = found(spark, rows, every=7), exact(rows, every=7)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_footrule_of_the_files_is_that_of_the_orders():
    rng = np.random.default_rng(7)
    order = np.stack([rng.permutation(40)[:8] for _ in range(50)]).astype(np.int16)
    files = pivot_index.Files(order, 40)
    for q in order[:10]:
        plain = [sum(max(0, 8 - i - abs(i - r.tolist().index(p))) for i, p in enumerate(q.tolist()) if p in r.tolist()) for r in order]
        assert files.saved(q).tolist() == plain


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pivot_index.nearest(empty, F.col("vec_id") % 100 == 0).collect() == []
    assert found(spark, [(1, [1.0, 2.0], 0), (2, None, 0)], every=1) == {}
