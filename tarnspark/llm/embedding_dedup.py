"""Near-duplicate embeddings by cross-polytope hashing, with multiprobe buckets and verified pairs.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the signed
axis nearest to the result. A table joins several such axes to a bucket. Every vector goes to the bucket of
its nearest axes and to those in which one axis is its second choice, so two vectors meet if any of their
buckets agree. Buckets are compared in blocks of bounded size by matrix products in double precision. A pair
counts only in the first bucket that both share, so counts of links are exact sums; only counts and one edge
for each vector leave a task, never the pairs. Equal vectors are one vector with a weight.

The number of axes of a bucket follows the table's size, so buckets stay small; the number of tables follows from both the
axes and the vectors' width: the driver hashes random pairs at the least cosine and takes as many tables as the
share of them that meets in one table asks for, so that all but MISSED of such pairs meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

PROBES = 3
#: Tables at least and at most; share of pairs at the least cosine that may be missed; random pairs to measure it on.
LEAST_TABLES, MOST_TABLES, MISSED, TRIALS = 8, 96, 0.002, 400
#: A bucket's blocks have so many vectors, on average.
BLOCK = 1000
#: Buckets up to this size are compared together; a task takes so many rows of small buckets.
SMALL, DEAL = 48, 20_000
#: Vectors that a bucket should hold, by which the number of axes of a bucket follows the table's size.
BUCKET = 16


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def axes_for(n: int, width: int) -> int:
    """Axes of a bucket for n vectors of a width, so that it holds BUCKET of them or so."""
    padded = 1 << max(1, (max(width, 2) - 1).bit_length())
    return max(1, round(math.log(max(n / BUCKET, 1)) / math.log(2 * padded)))


def tables_for(width: int, axes: int, least: float) -> int:
    """Tables in which all but MISSED of the pairs at cosine ``least`` share a bucket, by a trial on random pairs."""
    if width < 2:
        return LEAST_TABLES
    rng = np.random.default_rng(17)
    a, b = rng.normal(size=(2, TRIALS, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (buckets(v, axes, LEAST_TABLES) for v in (a, least * a + math.sqrt(1 - least * least) * b))
    share = float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())
    share = min(max(share, 1 / (TRIALS * LEAST_TABLES)), 1 - 1e-9)
    return min(MOST_TABLES, max(LEAST_TABLES, math.ceil(math.log(MISSED) / math.log(1 - share))))


def buckets(x: np.ndarray, axes: int, tables: int, seed: int = 13) -> np.ndarray:
    """Codes (vectors x tables x PROBES) of unit vectors; the first of a table is the nearest bucket."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    out = np.zeros((len(x), tables, PROBES), np.int64)
    for table in range(tables):
        best, second, loss = [], [], []
        for _ in range(axes):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], width)) / math.sqrt(width)
            size = np.abs(y)
            order = np.argsort(-size, axis=1)[:, : max(2, PROBES)] if width > 1 else np.zeros((len(x), 2), np.int64)
            rows = np.arange(len(x))[:, None]
            code = 2 * order + (y[rows, order] < 0)
            best.append(code[:, 0])
            second.append(code[:, 1:])
            loss.append(size[rows, order[:, :1]] - size[rows, order[:, 1:]])
        at = lambda codes: sum(c * (2 * width) ** k for k, c in enumerate(codes))
        out[:, table, :] = at(best)[:, None]
        # probes exchange one axis each, cheapest first
        options = [(k, r) for k in range(axes) for r in range(second[0].shape[1])]
        costs = np.stack([loss[k][:, r] for k, r in options], axis=1)
        codes = np.stack([at([second[k][:, r] if i == k else b for i, b in enumerate(best)]) for k, r in options], axis=1)
        chosen = np.argsort(costs, axis=1, kind="stable")[:, : PROBES - 1]
        out[:, table, 1 : 1 + chosen.shape[1]] = np.take_along_axis(codes, chosen, axis=1)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component under the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
    return label


def _close(x: np.ndarray, left: np.ndarray, right: np.ndarray, least: float):
    """Pairs of rows of ``left`` and ``right`` with a product of ``least`` or more."""
    for at in range(0, len(left), 512):
        a, b = np.nonzero(x[left[at : at + 512]] @ x[right].T >= least)
        yield left[at + a], right[b]


def _close_in_buckets(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: float):
    """Pairs within each bucket. Small buckets are compared together, row by row with the ones before."""
    for begin, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = np.arange(begin, begin + size)
        for a, b in _close(x, rows, rows, least):
            yield a[a < b], b[a < b]
    rank = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    later = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL)
    for back in range(1, SMALL):
        later = later[rank[later] >= back]
        for at in range(0, len(later), 20_000):
            b = later[at : at + 20_000]
            b = b[np.einsum("ij,ij->i", x[b], x[b - back]) >= least]
            yield b - back, b


def _narrow(codes: np.ndarray) -> list[bytes]:
    """Each vector's codes in the narrowest numbers that hold all of them."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if codes.max(initial=0) <= np.iinfo(t).max)
    flat = np.ascontiguousarray(codes.reshape(len(codes), -1).astype(kind))
    return [row.tobytes() for row in flat]


def _wide(codes: list[bytes], tables: int) -> np.ndarray:
    """All codes as numbers of one kind; vectors hashed in different batches may have come in different ones."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
    return np.stack([np.frombuffer(b, kinds[len(b) // (tables * PROBES)]).astype(np.int64) for b in codes]).reshape(len(codes), tables, PROBES)


def _units(vectors: list[bytes], kind) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(b, kind) for b in vectors]).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # squares of tiny or huge components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(batch: pd.DataFrame, least: float, kind) -> pd.DataFrame:
    """Links in whole buckets, or between two blocks of one: id, links owned by the bucket, a linked label."""
    table = int(batch["table"].iloc[0])
    batch = batch.sort_values(["code", "id"])
    ids, code, weight = batch["id"].to_numpy(), batch["code"].to_numpy(), batch["weight"].to_numpy()
    x = _units(batch["vector"].tolist(), kind)
    codes = _wide(batch["codes"].tolist(), int(batch["tables"].iloc[0]))
    low, high = int(batch["low"].iloc[0]), int(batch["high"].iloc[0])
    if low < 0:
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        found = _close_in_buckets(x, begins, np.diff(np.concatenate([begins, [len(code)]])), least)
    else:
        blocks = batch["block"].to_numpy()
        left, right = (np.flatnonzero(blocks == k) for k in (low, high))
        found = ((a[a < b], b[a < b]) if low == high else (a, b) for a, b in _close(x, left, right, least))
    count = np.zeros(len(ids), np.int64)
    found_a, found_b = [], []
    for a, b in found:
        found_a.append(a)
        found_b.append(b)
        own = np.ones(len(a), bool)
        for t in range(table + 1):
            for p in range(PROBES):
                same = (codes[a, t, p][:, None] == codes[b, t]) & own[:, None]
                if t == table:
                    same &= (codes[a, t, p] < code[a])[:, None]
                own &= ~same.any(axis=1)
        np.add.at(count, a[own], weight[b[own]])
        np.add.at(count, b[own], weight[a[own]])
    label = _roots(len(ids), np.concatenate(found_a), np.concatenate(found_b)) if found_a else np.arange(len(ids))
    some = (count > 0) | (label != np.arange(len(ids)))
    return pd.DataFrame({"id": ids[some], "links": count[some], "label": ids[label[some]]})


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links have a cosine of ``least`` or more.

    A vector that is null, empty, zero or has a null or non-finite component links with nothing and is its own
    component. Vectors of another length than most are compared among their own length only. A null vec_id
    links with nothing and has a null component; rows that repeat a vec_id count as vectors of their own in
    n_links. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    n = classes.count()
    # vectors are sent as they came; the comparison is in double precision
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def hashed(batches):
        chosen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            lengths = batch["v"].map(len)
            for width, part in batch.groupby(lengths):
                if width not in chosen:
                    axes = axes_for(n, int(width))
                    chosen[width] = axes, tables_for(int(width), axes, least)
                axes, tables = chosen[width]
                sent = [v.astype(kind).tobytes() for v in part["v"]]
                codes = buckets(_units(sent, kind), axes, tables)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "weight": part["weight"].to_numpy(), "length": width, "tables": tables, "vector": sent, "codes": _narrow(codes), "probes": list(codes.reshape(len(codes), -1))})

    found = cut(classes.mapInPandas(hashed, "id long, weight long, length int, tables int, vector binary, codes binary, probes array<long>"))
    probes = F.transform("probes", lambda c, i: F.struct(F.floor(i / PROBES).cast("int").alias("table"), c.alias("code")))
    where = found.select("id", "length", F.explode(F.array_distinct(probes)).alias("_p")).select("id", "length", "_p.table", "_p.code")
    units = found.drop("probes")
    sizes = where.groupBy("length", "table", "code").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    placed = where.join(sizes, ["length", "table", "code"])
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # buckets of one block go to tasks by the dozen, those of several block by block
    deals = max(1, -(-n * PROBES // DEAL))
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.xxhash64("code").alias("deal"), F.least("block", k).alias("low"), F.greatest("block", k).alias("high")))
    whole = F.array(F.struct(F.pmod(F.xxhash64("code"), F.lit(deals)).alias("deal"), F.lit(-1).alias("low"), F.lit(-1).alias("high")))
    dealt = placed.select("id", "length", "table", "code", "block", F.explode(F.when(blocks == 1, whole).otherwise(meets)).alias("_m")).select("id", "length", "table", "code", "block", "_m.*")
    compared = dealt.join(units.drop("length"), "id").groupBy("length", "table", "deal", "low", "high").applyInPandas(lambda batch: _compare(batch, least, kind), "id long, links long, label long")
    found = cut(compared)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("id").alias("a"), F.col("label").alias("b")))
    own = classes.join(links, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    own = own.select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = good.join(own, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
