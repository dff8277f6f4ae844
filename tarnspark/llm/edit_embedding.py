"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A shared random walk reads a text: at step j it writes the character under it and moves on or stays, as a
random bit fixed for (j, character) says. Two texts at a small edit distance soon walk in step again, so
edit distance becomes Hamming distance between the walks. A fingerprint keeps a shared random sample of a
walk's steps. Steps have nested levels: level k has one step in 2**k, and a text takes the level that
leaves it some tens of steps, so texts of different lengths are compared on the coarser sample of the two.
What a walk writes behind its text's end is left out of fingerprints, bands and likeness.

Near texts are found by bands: runs of sampled steps, of the text's own level and of the next coarser one, so texts on both
sides of a level's bound share bands. All that share a band are candidates, however many; their fingerprints decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, shuffle_width
from .components import components
from .near_dedup import compared_parts, reach

#: Steps of a walk for each character; steps that a fingerprint samples of it at most, on average.
STRETCH, SAMPLED = 3, 96
#: Range partitions at most (their bounds are one array); characters that a worker embeds together. A partition streams.
PARTITIONS, BATCH_CHARS = 1 << 14, 4 << 20
#: When so few texts of a batch are left, each goes on by itself.
FEW = 12
#: Parts of the rows without a doc_id.
NO_ID_PARTS = 16
#: Sampled steps of a band, and the likeness that verification asks for.
BAND, LIKE = 6, 0.8

_ROWS = 4096
_rng = np.random.default_rng(11)
_MOVES = _rng.integers(0, 2, size=(_ROWS, 256), dtype=np.int64)
_MOVES[:, 0] = 0  # behind the text's end
_TURN = _rng.integers(0, _ROWS, size=1 << 16)
_MOVE = [row.astype(np.uint8).tobytes() for row in _MOVES]


def step_levels(start: int, stop: int) -> np.ndarray:
    """Levels of steps start to stop: the number of low zero bits of a hash of the step."""
    x = np.arange(start, stop, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x = (x & np.uint64(0x7FFFFFFF)) | np.uint64(1 << 31)
    return np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64)


def _level(n: int) -> int:
    return max(0, int(np.ceil(np.log2(STRETCH * n / SAMPLED)))) if n else 0


def _symbols(text: str) -> np.ndarray:
    """Characters as 1 to 255: by themselves where that is possible, else by a hash."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(x < 256, x, (x * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8) | (x == 0).astype(np.uint8)


def _walk_on(text: bytes, at: int, start: int, sampled: np.ndarray, out: np.ndarray, k: int) -> None:
    """Go on with one text's walk from a step, writing what it samples from out[k] on, up to the text's end."""
    sampled = sampled[k:].tolist()
    for first in range(start, sampled[-1] + 1 if sampled else start, 1 << 16):
        j = np.arange(first, first + (1 << 16))
        rows = (_TURN[j & 0xFFFF] ^ ((j >> 16) & (_ROWS - 1))).tolist()
        here = 0
        while sampled and here < len(rows):
            stop = min(sampled[0] - first, len(rows))
            for row in rows[here:stop]:
                at += _MOVE[row][text[at]]
            here = stop
            if here < len(rows):
                out[k] = text[at]
                at += _MOVE[rows[here]][text[at]]
                k, here = k + 1, here + 1
                sampled.pop(0)
        if not text[at]:
            break


def embed(texts: list[str]) -> list[tuple[int, bytes]]:
    """(level, sampled characters) of each text. One pass over steps takes all texts at once."""
    found: list = [(0, b"")] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    if not order:
        return found
    parts = [_symbols(texts[i]) for i in order]
    n = np.array([len(p) for p in parts])
    codes = np.zeros(int(n.sum()) + len(n), np.uint8)
    begins = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    for p, at in zip(parts, begins, strict=True):
        codes[at : at + len(p)] = p
    levels = np.array([_level(int(x)) for x in n])
    steps = STRETCH * int(n[0])
    of_step = step_levels(0, steps)
    groups = []  # of texts with the same level: first row, end, samples, which sample comes next
    for level in np.unique(levels):
        lo, hi = np.searchsorted(-levels, -level), np.searchsorted(-levels, -level, side="right")
        longest = STRETCH * int(n[lo])
        groups.append([int(level), int(lo), int(hi), np.zeros((hi - lo, int((of_step[:longest] >= level).sum())), np.uint8), 0])
    rows, pos = np.arange(len(n)), begins.copy()
    at = [(np.searchsorted(rows, g[1]), np.searchsorted(rows, g[2])) for g in groups]
    for first in range(0, steps, 256):
        for j in range(first, min(first + 256, steps)):
            c = codes[pos]
            level = of_step[j]
            for g, (lo, hi) in zip(groups, at, strict=True):
                if g[0] > level:
                    break
                if hi > lo and g[4] < g[3].shape[1]:
                    g[3][rows[lo:hi] - g[1], g[4]] = c[lo:hi]
                g[4] += 1
            pos += _MOVES[_TURN[j & 0xFFFF] ^ (j >> 16) & (_ROWS - 1)][c]
        going = codes[pos] != 0
        if going.sum() <= FEW and first + 256 < steps:
            for r, p in zip(rows[going], pos[going], strict=True):
                level, lo, _, samples, k = next(g for g in groups if g[1] <= r < g[2])
                sampled = np.flatnonzero(of_step[: STRETCH * int(n[r])] >= level)
                _walk_on(codes[begins[r] : begins[r] + n[r] + 1].tobytes(), int(p - begins[r]), first + 256, sampled, samples[r - lo], k)
            break
        if not going.all():
            rows, pos = rows[going], pos[going]
            if not len(rows):
                break
            at = [(np.searchsorted(rows, g[1]), np.searchsorted(rows, g[2])) for g in groups]
    for level, lo, hi, samples, _ in groups:
        counts = np.concatenate([[0], np.cumsum(of_step >= level)])
        for r in range(lo, hi):
            found[order[r]] = (level, samples[r - lo, : counts[STRETCH * int(n[r])]].tobytes().rstrip(b"\0"))
    return found


_marks: dict[int, np.ndarray] = {}


def coarser(fingerprint: tuple[int, bytes], level: int) -> np.ndarray:
    """The samples of a fingerprint that a coarser level has as well."""
    own, samples = fingerprint[0], np.frombuffer(fingerprint[1], np.uint8)
    if own == level:
        return samples
    stop = 1 << max(10, (len(samples) + 16).bit_length() + own + 1)
    while own not in _marks or len(_marks[own]) < len(samples):
        of_step = step_levels(0, stop)
        _marks[own], stop = of_step[of_step >= own].astype(np.int8), stop * 2
    return samples[_marks[own][: len(samples)] >= level]


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """Share of equal characters among the sampled steps of both walks, on the coarser level of the two."""
    level = max(a[0], b[0])
    x, y = coarser(a, level), coarser(b, level)
    longest, m = max(len(x), len(y)), min(len(x), len(y))
    return float((x[:m] == y[:m]).sum() / longest) if longest else float(a[1] == b[1])


def bands(fingerprint: tuple[int, bytes]) -> list[int]:
    """Hashes of the runs of BAND samples of the fingerprint's level and of the next coarser one; of a short text, of all it has."""
    out = []
    for level in (fingerprint[0], fingerprint[0] + 1):
        samples = coarser(fingerprint, level).tobytes()
        for at in range(0, max(1, len(samples) - BAND + 1), BAND):
            name = b"%d.%d.%b" % (level, at, samples[at : at + BAND])
            out.append(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "big", signed=True))
    return out


def to_string(fingerprint: tuple[int, bytes]) -> str:
    return f"{fingerprint[0]:x}.{fingerprint[1].hex()}"


def from_string(s: str) -> tuple[int, bytes]:
    level, _, samples = s.partition(".")
    return int(level, 16), bytes.fromhex(samples)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, copy, key, doc_id, text): documents by ranges of doc_id, each range followed by a copy of the next one's first.

    Texts are shuffled once. The driver learns only the bounds and the first key of each range. Rows without a doc_id come
    last, in the order of a hash of their texts, in parts of their own.
    """
    none = F.col("doc_id").isNull()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.when(none, F.xxhash64("text")).otherwise(F.col("doc_id").cast("long")))
    n = min(PARTITIONS, shuffle_width(docs.sparkSession))
    bounds = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    table, steps = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    # how many bounds are no greater than the key, by halving
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= F.col("key")), at + step).otherwise(at)) if bounds else F.lit(0)
    last = len(bounds) + 1
    part = F.when(none, last + F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 60).cast("int")).otherwise(place)
    keyed = keyed.withColumn("part", part)
    heads = sorted(keyed.groupBy("part").agg(F.min("key").alias("key")).collect())
    if not heads:
        return keyed.select("part", F.lit(False).alias("copy"), "key", "doc_id", "text")
    first, before = [None] * (last + NO_ID_PARTS), [None] * (last + NO_ID_PARTS)
    for i, h in enumerate(heads):
        first[h["part"]], before[h["part"]] = h["key"], heads[i - 1]["part"]
    listed = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    to = F.when(F.get(listed(first, "long"), F.col("part")) == F.col("key"), F.get(listed(before, "int"), F.col("part")))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("copy")), F.struct(to.alias("part"), F.lit(True).alias("copy")))
    rows = keyed.select("key", "doc_id", "text", F.explode(F.filter(places, lambda x: x["part"].isNotNull())).alias("_p"))
    rows = rows.select(F.col("_p.part").alias("part"), F.col("_p.copy").alias("copy"), "key", "doc_id", "text")
    return rows.repartitionById(last + NO_ID_PARTS, F.col("part")).sortWithinPartitions("part", "copy", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last quarter of code points replaced by the first as many of the next document.
    A null text counts as empty; two empty texts are alike (1), an empty and another are not (0). Rows with one
    doc_id follow each other by text; null doc_ids come last, by a hash of their texts. Other columns are ignored; an empty table gives
    an empty result.
    """

    def run(batches):
        def compare(rows):
            texts = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:], strict=False)]
            found = embed(texts + edited)
            own, new = found[: len(texts)], found[len(texts) :]
            return pd.DataFrame(
                {
                    "doc_id": [d for d, _ in rows[:-1]],
                    "n_chars": [len(t) for t in texts[:-1]],
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                    "fingerprint": [to_string(x) for x in own[:-1]],
                    "edited_fingerprint": [to_string(x) for x in new],
                    "near_edited": [likeness(a, b) for a, b in zip(own, new, strict=False)],
                    "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
                }
            )

        held, size, at, closed = [], 0, None, False
        for batch in batches:
            for part, copy, doc, text in zip(batch["part"].tolist(), batch["copy"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                if part != at:
                    held, size, at, closed = [], 0, part, False
                if closed:
                    continue
                held.append((doc, text))
                size += len(text)
                if len(held) > 1 and (copy or size > BATCH_CHARS):
                    yield compare(held)
                    held, size = held[-1:], len(text)
                closed = copy

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = _with_next(lean(docs)).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def near_groups(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, component_id, kept of every document: groups of texts that are linked by a likeness of ``like`` or more.

    Documents with equal fingerprints are one node; all nodes that share a band are compared. A null text counts as empty
    and empty texts are equal. Rows with a null doc_id have a null component and are kept; repeated rows of a
    doc_id are all returned and stand for one document. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 500):
                found = embed(texts[at : at + 500])
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at : at + 500], "print": [to_string(x) for x in found], "bands": [bands(x) for x in found]})

    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = cut(rows.where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long, print string, bands array<long>"))
    nodes = cut(known.groupBy("print").agg(F.min(F.struct("doc_id", "bands")).alias("_m")).select("print", F.col("_m.doc_id").alias("node"), F.col("_m.bands").alias("bands")))
    parts = compared_parts(nodes.select(F.lit(0).alias("tree"), F.explode("bands").alias("label"), "node").distinct())

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["part", "node"])
        found, names, ids, out = [from_string(x) for x in batch["print"]], batch["part"].to_numpy(), batch["node"].to_numpy(), []
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        for begin, end in zip(cuts, cuts[1:], strict=False):
            own = found[begin:end]
            root = reach(end - begin, lambda i, open_, own=own: np.array([likeness(own[i], own[j]) >= like for j in open_], bool))
            out += [(int(ids[begin + i]), int(ids[begin + r])) for i, r in enumerate(root) if r != i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    links = parts.join(nodes.select("node", "print"), "node").groupBy("deal").applyInPandas(compare, "a long, b long")
    same = known.select("doc_id", "print").join(nodes.select("print", "node"), "print").where(F.col("doc_id") != F.col("node")).select("doc_id", "node")
    group = components(links.union(same)).withColumnRenamed("node", "doc_id")
    out = known.select("doc_id").join(group, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.union(rows.where(F.col("doc_id").isNull()).select("doc_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
