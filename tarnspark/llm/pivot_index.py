"""Nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its LENGTH nearest pivots in order, and is posted under
each of them, with its place in that order, in the pivots' inverted files. A query reads the files of its own nearest pivots,
adds up the footrule distance of its order to every order that it meets there, and only what is close enough by footrule is
compared by its vectors. A pivot that is missing or too far out of place counts as if it stood behind the order's end.

The index is dealt by vectors: those with the same nearest one of the first pivots are a shard (in blocks, if there are many),
which holds the inverted files of its own members, so a footrule is whole where it is made and neither hits nor candidates are
shuffled, only each query's best of a block. Queries go to the shards of their own nearest pivots. As pivots are drawn from
the data, crowds get as many of them as their share, and shards stay even. How many shards a query goes to and which footrule is
close enough follows from a trial: a bounded number of the queries is answered from all shards in full, and the bounds are
set so that the shares VISIT and KEEP of their neighbours are within them. A query that finds too few is answered in full.

Equal vectors are one, with the smallest of their ids, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pivots at least and at most; between them, so many times the square root of the vectors.
LEAST_PIVOTS, MOST_PIVOTS, BY_ROOT = 256, 4096, 2
#: Pivots of a vector's order.
LENGTH = 64
#: Vectors of a shard and of a block of it, queries that meet a block at once, about.
SHARD, BLOCK, QUERIES = 4000, 8000, 2000
#: Queries of the trial, and the shares of their neighbours whose shards are visited and whose footrule is close enough.
TRIAL, VISIT, KEEP = 200, 0.99, 0.96
#: Ids of one vector that a task gathers, about.
IDS = 100_000

POSTED = "length int, h long, g long, x binary, ids array<long>, asked boolean, order binary, shard int, shards array<int>"
FOUND = "length int, qh long, qg long, vec_id long, score double, saved int, visit int, own boolean"


def _wide(values, kind) -> np.ndarray:
    return np.stack([np.frombuffer(b, kind) for b in values]).astype(np.float64)


def orders(x: np.ndarray, pivots: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivots in order, and the order of the first ``shards`` of the pivots."""
    with np.errstate(all="ignore"):
        far = (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :LENGTH].astype(np.int16), np.argsort(far[:, :shards], axis=1, kind="stable")


class Files:
    """Inverted files of a block: under each pivot, the rows that have it in their order, and its place there."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.length = order.shape
        flat = order.ravel()
        at = np.argsort(flat, kind="stable")
        self.rows, self.places = at // self.length, (at % self.length).astype(np.int32)
        self.begins = np.searchsorted(flat[at], np.arange(pivots + 1))

    def saved(self, order: np.ndarray) -> np.ndarray:
        """For each row, by how much its footrule distance to ``order`` is less than that of a row that shares no pivot."""
        out = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(order.tolist()):
            part = slice(self.begins[pivot], self.begins[pivot + 1])
            out[self.rows[part]] += np.maximum(0, self.length - place - np.abs(self.places[part] - place))
        return out


def best(distance: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, rows, distances of the k nearest different ids, ties to the smaller one. A row has several ids."""
    n = k
    while True:
        last = np.partition(distance, n - 1)[n - 1] if n < len(distance) else np.inf
        rows = np.flatnonzero(distance <= last) if n < len(distance) else np.arange(len(distance))
        each = np.repeat(rows, [len(ids[r]) for r in rows])
        names = np.concatenate([ids[r] for r in rows])
        at = np.lexsort((names, distance[each]))
        names, each = names[at], each[at]
        first = np.sort(np.unique(names, return_index=True)[1])[:k]
        if len(first) == k or n >= len(distance):
            return names[first], each[first], distance[each[first]]
        n *= 2


def _meet(members: pd.DataFrame, queries: pd.DataFrame, kind, limits: dict[int, int], k: int) -> pd.DataFrame:
    """The queries' nearest among a block's members whose saved footrule isn't below the limit."""
    if not len(members) or not len(queries):
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
    x, order = _wide(members["x"], kind), np.stack([np.frombuffer(b, np.int16) for b in members["order"]])
    ids = [np.asarray(i, np.int64) for i in members["ids"]]
    h, g = members["h"].to_numpy(), members["g"].to_numpy()
    length = int(members["length"].iloc[0])
    files, out = Files(order, MOST_PIVOTS), []
    for qh, qg, qx, qorder, visit in zip(queries["q_h"].tolist(), queries["q_g"].tolist(), _wide(queries["q_x"], kind), queries["q_order"], queries["q_visit"].tolist(), strict=True):
        saved = files.saved(np.frombuffer(qorder, np.int16))
        rows = np.flatnonzero(saved >= limits[length])
        if not len(rows):
            continue
        with np.errstate(all="ignore"):
            far = np.sqrt(((x[rows] - qx) ** 2).sum(axis=1))
        names, at, score = best(far, [ids[r] for r in rows], k)
        own = (h[rows[at]] == qh) & (g[rows[at]] == qg)
        out.append(pd.DataFrame({"length": length, "qh": qh, "qg": qg, "vec_id": names, "score": score, "saved": saved[rows[at]], "visit": visit, "own": own}))
    return pd.concat(out) if out else _meet(members.iloc[:0], queries, kind, limits, k)


def _sample(rows: DataFrame, sizes: DataFrame, most: str) -> DataFrame:
    """The rows of the smallest hashes, as many of each length as ``most`` of sizes says; what is sorted follows that number."""
    draw = F.xxhash64(F.lit(41), "h", "g")
    some = rows.join(F.broadcast(sizes), "length").where(F.pmod(draw, F.greatest("n", F.lit(1))) < 3 * F.col(most))
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("length").orderBy(draw, "h", "g"))).where(F.col("_n") <= F.col(most)).drop("_n")


def _bounds(trial: DataFrame, shards: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each length the shards to visit and the least saved footrule, by a trial's neighbours other than the query's own vector."""
    found: dict[int, list[tuple[int, int]]] = {w: [] for w in shards}
    for r in trial.where(~F.col("own")).select("length", "visit", "saved").collect():
        found[r["length"]].append((r["visit"], r["saved"]))
    at = lambda values, share: sorted(values)[math.ceil(share * len(values)) - 1]
    visits = {w: at([v for v, _ in f], VISIT) + 1 if f else shards[w] for w, f in found.items()}
    return visits, {w: -at([-s for _, s in f], KEEP) if f else 0 for w, f in found.items()}


def nearest(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of every row of ``vectors`` (vec_id, embedding) that is ``asked`` for,
    by Euclidean distance in double precision, nearest first, ties to the smaller vec_id; all others, if they are fewer.

    Vectors that are null, empty or zero, or have a null or non-finite component, and rows without a vec_id take no part. Vectors
    are compared with those of their own length. Rows that repeat a vec_id are one, as near as the nearest of their vectors,
    and aren't their own neighbours. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    # vectors travel as they came; adding 0.0 makes one zero of two
    v = F.transform(v.cast("array<float>" if single else "array<double>"), lambda c: c + F.lit(0.0).cast("float" if single else "double"))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(7), "v")})

    # equal vectors: their k + 1 smallest ids
    parts = max(1, math.ceil(rows.count() / IDS))
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    one = rows.groupBy("v", "h", "g", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).agg(smallest(F.collect_set("id")).alias("ids"), F.bool_or("asked").alias("asked"))
    if parts > 1:
        one = one.groupBy("v", "h", "g").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"), F.bool_or("asked").alias("asked"))
    one = cut(one.select("v", "h", "g", "ids", "asked", F.size("v").alias("length")))

    counts = [(r["length"], r["n"], r["asked"], r["ids"]) for r in one.groupBy("length").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.sum(F.size("ids")).alias("ids")).collect()]
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots_of = {w: min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(BY_ROOT * math.sqrt(n)))) for w, n, _, _ in counts}
    sizes = spark.createDataFrame([(w, n, pivots_of[w]) for w, n, _, _ in counts], "length int, n long, most int")
    found = _sample(one.select("length", "v", "h", "g"), sizes, "most").orderBy("length", "h", "g").collect()
    pivots = {w: np.array([r["v"] for r in found if r["length"] == w], np.float64) for w in pivots_of}
    shards_of = {w: max(1, min(len(pivots[w]), n // SHARD)) for w, n, _, _ in counts}
    shared = spark.sparkContext.broadcast(pivots)

    def post(batches):
        for batch in batches:
            for length, part in batch.groupby("length"):
                sent = [np.asarray(x, kind).tobytes() for x in part["v"]]
                for at in range(0, len(part), 1000):
                    some = part.iloc[at : at + 1000]
                    order, shards = orders(_wide(sent[at : at + 1000], kind), shared.value[length], shards_of[length])
                    goes = [s.tolist() if a else None for s, a in zip(shards, some["asked"], strict=True)]
                    yield pd.DataFrame({"length": length, "h": some["h"], "g": some["g"], "x": sent[at : at + 1000], "ids": some["ids"], "asked": some["asked"], "order": [o.tobytes() for o in order], "shard": shards[:, 0], "shards": goes})

    posted = cut(one.mapInPandas(post, POSTED))
    members = posted.select("length", "h", "g", "x", "ids", "order", "shard")
    blocks = F.broadcast(cut(members.groupBy("length", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))))
    where = ["length", "shard", "block", "part"]

    def search(queries: DataFrame, visits: dict[int, int], limits: dict[int, int]) -> DataFrame:
        """Each query's k + 1 nearest, its own ids among them, from the shards it visits."""
        most = F.create_map(*[F.lit(x) for pair in visits.items() for x in pair])
        go = queries.select("length", "h", "g", "x", "order", F.posexplode(F.slice("shards", F.lit(1), F.element_at(most, F.col("length")))).alias("visit", "shard"))
        load = F.broadcast(cut(go.groupBy("length", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))))
        go = go.join(load, ["length", "shard"]).join(blocks, ["length", "shard"]).withColumn("part", F.pmod("g", F.col("parts")).cast("int"))
        go = go.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        at = members.join(load, ["length", "shard"]).join(blocks, ["length", "shard"]).withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
        at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asks = go.select(*[F.col(c).alias(f"q_{c}") for c in (*where, "h", "g", "x", "order", "visit")])
        met = at.select(*where, "h", "g", "x", "order", "ids").groupBy(*where).cogroup(asks.groupBy(*[f"q_{c}" for c in where]))
        near = met.applyInPandas(lambda a, b: _meet(a, b, kind, limits, k + 1), FOUND)
        # an id that came with several vectors counts once, and a query's rows of all blocks are its best of each
        near = near.repartition("qh", "qg").groupBy("length", "qh", "qg", "vec_id").agg(F.min(F.struct("score", "saved", "visit", "own")).alias("_b")).select("length", "qh", "qg", "vec_id", "_b.*")
        order = Window.partitionBy("qh", "qg").orderBy("score", "vec_id")
        return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")

    queries, none = posted.where("asked"), dict.fromkeys(shards_of, 0)
    trial = _sample(queries, spark.createDataFrame([(w, a, TRIAL) for w, _, a, _ in counts], "length int, n long, most int"), "most")
    visits, limits = _bounds(search(trial, shards_of, none), shards_of)
    near = cut(search(queries, visits, limits))
    # what has found fewer than there are is answered in full
    need = F.create_map(*[F.lit(x) for w, _, _, ids in counts for x in (w, min(k + 1, ids))])
    few = near.groupBy(F.col("qh").alias("h"), F.col("qg").alias("g")).agg(F.count("*").alias("_n"))
    short = queries.join(few, ["h", "g"], "left").where(F.coalesce("_n", F.lit(0)) < F.element_at(need, F.col("length"))).select(*posted.columns)
    short = cut(short)
    if short.count():
        rest = near.join(short.select(F.col("h").alias("qh"), F.col("g").alias("qg")), ["qh", "qg"], "left_anti")
        near = rest.unionByName(cut(search(short, shards_of, none)))
    names = rows.where("asked").select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("g").alias("qg")).distinct()
    pairs = names.join(near, ["qh", "qg"]).where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
