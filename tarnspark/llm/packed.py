"""Documents packed into groups of a few megabytes, and columns of numbers packed into binary values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a group, about.
GROUP_BYTES = 16 << 20
#: A null doc_id takes its place behind all others.
NO_ID = (1 << 63) - 1


def dense(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def loose(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def pack(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text -> g, ids, sizes, data: each task's documents of a group in one row."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for g, (ids, sizes, parts) in held.items():
                yield {"g": g, "ids": np.array(ids, np.int64).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "data": zstandard.ZstdCompressor(level=1).compress(b"".join(parts))}

        for batch in batches:
            for g, doc, text in zip(batch["g"].tolist(), batch["doc"].tolist(), batch["text"].tolist(), strict=True):
                b = text.encode()
                ids, sizes, parts = held.setdefault(g, ([], [], []))
                ids.append(doc)
                sizes.append(len(b))
                parts.append(b)
                size += len(b)
            if size > 4 * GROUP_BYTES:
                yield pd.DataFrame(list(flush()))
                held, size = {}, 0
        if held:
            yield pd.DataFrame(list(flush()))

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int").alias("g"), doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "g int, ids binary, sizes binary, data binary")


class Group:
    """The documents of a group, in the order of their ids and texts, end to end."""

    def __init__(self, rows: pd.DataFrame):
        found = []
        for ids, sizes, data in zip(rows["ids"], rows["sizes"], rows["data"], strict=True):
            data, at = zstandard.ZstdDecompressor().decompress(data), 0
            for doc, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.int64).tolist(), strict=True):
                found.append((doc, data[at : at + n]))
                at += n
        found.sort()
        self.ids = np.array([d for d, _ in found], np.int64)
        self.ends = np.cumsum([len(b) for _, b in found], dtype=np.int64)
        self.begins = self.ends - np.array([len(b) for _, b in found], np.int64)
        self.bytes = b"".join(b for _, b in found)
        self.data = np.frombuffer(self.bytes, np.uint8)


def by_bucket(buckets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices) of every bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    return [(int(buckets[part[0]]), part) for part in np.split(order, cuts[1:])] if len(order) else []
