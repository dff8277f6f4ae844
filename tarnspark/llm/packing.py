"""Harmonic packing of tokenised documents into sequences of at most ``capacity`` tokens.

Each document's ids, with an end id behind them, are cut into whole sequences and a rest. Rests are
put in reciprocal-capacity classes: class k holds lengths of capacity/(k+1) to capacity/k, and each of
its bins takes exactly k of them. What a bin lacks is filled by cutting from the rests that found no
bin, smallest classes first; what is left in the end is cut into sequences whose lengths are powers
of two. So no sequence needs padding. Every worker packs blocks of its own documents without knowing
of the others: there is no shuffle, and a document's ids are made once.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import bytes_of, default_path, worker_cache

CAPACITY = 4096
END_ID = 2
#: Rests shorter than capacity / (CLASSES + 1) only fill up bins.
CLASSES = 16
#: A worker packs so many documents or bytes of ids together.
BLOCK_DOCUMENTS, BLOCK_BYTES = 4096, 32 << 20


def pack_block(lengths: list[int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces; documents and sequences are numbered from 0."""
    pieces, sequences = [], 0
    by_class: dict[int, list] = {k: [] for k in range(1, classes + 1)}
    fillers: list = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append((doc, start, capacity, sequences, 0))
            sequences, start = sequences + 1, start + capacity
        if rest := n - start:
            by_class.get(capacity // rest, fillers).append((doc, start, rest))
    bins: deque = deque()
    for k, items in by_class.items():
        whole = len(items) - len(items) % k
        bins.extend(items[i : i + k] for i in range(0, whole, k))
        fillers.extend(items[whole:])
    fillers.sort(key=lambda x: -x[2])  # the shortest is taken first
    while bins:
        items, need = bins.popleft(), 0
        need = capacity - sum(x[2] for x in items)
        filled = []
        while need and (fillers or bins):
            if not fillers:
                fillers.extend(bins.pop())  # of the class with the shortest rests
                continue
            doc, start, n = fillers.pop()
            filled.append((doc, start, min(n, need)))
            if n > need:
                fillers.append((doc, start + need, n - need))
            need -= min(n, need)
        if need:  # nothing is left to fill with
            fillers = [*items, *filled]
            break
        offset = 0
        for doc, start, n in [*items, *filled]:
            pieces.append((doc, start, n, sequences, offset))
            offset += n
        sequences += 1
    left = sum(x[2] for x in fillers)
    fillers.reverse()
    while left:
        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        left, offset = left - room, 0
        while offset < room:
            doc, start, n = fillers.pop()
            take = min(n, room - offset)
            pieces.append((doc, start, take, sequences, offset))
            offset += take
            if n > take:
                fillers.append((doc, start + take, n - take))
        sequences += 1
    return pieces


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed as often as they occur; a null
    doc_id is kept. sequence_id holds the task's number in its upper bits, so tasks need not agree on it.
    Other columns are ignored. ``capacity`` has to be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache = worker_cache(path, bytes_of, b"".join)
        first = TaskContext.get().partitionId() << 32
        held, names, size = [], [], 0

        def block():
            nonlocal first
            lengths = [len(b) // 4 for b in held]
            rows = pack_block(lengths, capacity)
            if not rows:
                return None
            doc, start, length, sequence, offset = (list(x) for x in zip(*rows, strict=True))
            crc = [zlib.crc32(memoryview(held[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc, start, length, strict=True)]
            out = pd.DataFrame({"doc_id": [names[d] for d in doc], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": [lengths[d] for d in doc], "sequence_id": [first + s for s in sequence], "offset": offset})
            first += max(sequence) + 1
            return out

        for batch in batches:
            texts, ids = batch["text"].fillna("").tolist(), batch["doc_id"].tolist()
            for at in range(0, len(texts), 1000):
                for name, b in zip(ids[at : at + 1000], cache.texts(texts[at : at + 1000]), strict=True):
                    b += end
                    held.append(b)
                    names.append(name)
                    size += len(b)
                    if len(held) >= BLOCK_DOCUMENTS or size >= BLOCK_BYTES:
                        yield block()
                        held, names, size = [], [], 0
        if held:
            yield block()

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = lean(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
