"""Exact substring dedup: bytes under a string of LENGTH bytes that starts in an earlier document go.

The order of all suffixes by their first LENGTH bytes is found by induction from a sample. Sampled suffixes
are those that are the least of a hash order in some window of LENGTH bytes; like the sample of induced
sorting it depends on the content alone, so equal windows sample the same place.

1. Names. Every group of documents sends the names (hashes of KEY bytes) of its sampled suffixes, once
   each, to the name's bucket, and learns which occur in other groups too.
2. Contexts. For these a group sends the suffix tuple: its name, the bytes up to LENGTH - KEY in front
   and LENGTH from there on, with how many of each lie in the document, and the least doc_id that has it.
3. Induction. In a bucket the tuples of a name are sorted; from each, the order of the windows that start
   up to LENGTH - KEY bytes earlier follows, and with it each window's least doc_id in the whole corpus.
4. Removal. Groups look their suffixes up in the answers and mark the windows that an earlier document has.

Everything that is exchanged is distinct within a group first, so a passage that a third of all documents
share costs one tuple for each group. The exchanges sort and spill on disk; a task holds one group of about
GROUP_BYTES or the tuples of one bucket. All of it is one query, so the packed groups are shuffled once
and their exchange is read three times. Strings are told apart by 64-bit hashes of them and of their name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, total_bytes
from .hashing import Windows, mix64
from .packed import GROUP_BYTES, NO_ID, Group, by_bucket, dense, loose, pack

LENGTH, KEY = 50, 24
_LEAD = LENGTH - KEY
_CHUNK, _ROWS = 1 << 20, 1 << 14


def sampled(group: Group, with_context: bool):
    """Chunks of (place, name, document[, context hash, bytes in front, bytes from there on]) of sampled suffixes."""
    n = len(group.data)
    for c0 in range(0, max(0, n - LENGTH + 1), _CHUNK):
        c1 = min(c0 + _CHUNK, n - LENGTH + 1)
        lo, hi = max(0, c0 - _LEAD), min(n, c1 + 2 * LENGTH)
        windows = Windows(group.data[lo:hi])
        names = windows.every(KEY)
        local = names[c0 - lo : c1 - lo + _LEAD]
        least = (local & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(local), dtype=np.uint64)
        span = 1
        while 2 * span <= _LEAD + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = _LEAD + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + c0
        first, last = np.searchsorted(group.ends, c0, side="right"), np.searchsorted(group.ends, c1 - 1, side="right")
        docs = np.arange(first, last + 1)
        lengths = np.minimum(group.ends[docs], c1) - np.maximum(group.begins[docs], c0)
        owner = np.repeat(docs, lengths)
        place, owner = (x[np.arange(c0, c1) + LENGTH <= group.ends[owner]] for x in (place, owner))
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        place, owner = place[new], owner[new]
        name = names[place - lo]
        if not with_context:
            yield place, name, owner
            continue
        front = np.minimum(_LEAD, place - group.begins[owner])
        onward = np.minimum(LENGTH, group.ends[owner] - place)
        context = mix64(windows.of(place - front - lo, place + onward - lo) + (front * 64 + onward).astype(np.uint64))
        yield place, name, owner, context ^ name, front, onward


def _names(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    g = int(rows["g"].iloc[0])
    parts = [np.unique(name) for _, name, _ in sampled(Group(rows), False)]
    names = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    out = [(k, g, names[at].tobytes()) for k, at in by_bucket((names % np.uint64(buckets)).astype(np.int64))]
    return pd.DataFrame(out, columns=["bucket", "g", "names"])


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    found = [np.frombuffer(b, np.uint64) for b in rows["names"]]
    names, counts = np.unique(np.concatenate(found), return_counts=True)
    names = names[counts > 1]
    out = [(g, hit.tobytes()) for g, x in zip(rows["g"], found, strict=True) if len(hit := x[np.isin(x, names, assume_unique=False)])]
    return pd.DataFrame(out, columns=["g", "names"])


def _tuples(rows: pd.DataFrame, shared: pd.DataFrame, buckets: int) -> pd.DataFrame:
    columns = ["bucket", "g", "sides", "doc", "text"]
    if not len(rows):
        return pd.DataFrame(columns=columns)
    group, g = Group(rows), int(rows["g"].iloc[0])
    known = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in shared["names"]])) if len(shared) else np.zeros(0, np.uint64)
    parts = list(sampled(group, True))
    if not parts:
        return pd.DataFrame(columns=columns)
    place, name, owner, context, front, onward = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((owner, name))
    low, high = owner[order], np.empty(0)
    heads = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    low, high = low[heads], owner[order][np.concatenate([heads[1:], [len(order)]]) - 1]
    here = name[order][heads][group.ids[low] != group.ids[high]]
    want = np.isin(name, np.union1d(known, here))
    place, name, owner, context, front, onward = (x[want] for x in (place, name, owner, context, front, onward))
    order = np.lexsort((owner, context))  # documents stand in the order of their ids
    one = order[np.concatenate([[True], context[order][1:] != context[order][:-1]])] if len(order) else order
    place, name, owner, context, front, onward = (x[one] for x in (place, name, owner, context, front, onward))
    doc, offset, out = group.ids[owner], np.arange(-_LEAD, LENGTH), []
    for k, at in by_bucket((name % np.uint64(buckets)).astype(np.int64)):
        inside = (offset >= -front[at, None]) & (offset < onward[at, None])
        text = np.where(inside, group.data[np.clip(place[at, None] + offset, 0, len(group.data) - 1)], np.uint8(0))
        out.append((k, g, dense(np.stack([front[at], onward[at]], axis=1).astype(np.uint8)), dense(doc[at]), dense(text)))
    return pd.DataFrame(out, columns=columns)


def _named(sides: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and context hashes of tuples, from their bytes."""
    names, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(text), _ROWS):
        part, (front, onward) = text[at : at + _ROWS], sides[at : at + _ROWS].T
        windows = Windows(part.reshape(-1))
        place = np.arange(len(part)) * (_LEAD + LENGTH) + _LEAD
        name = windows.at(place, KEY)
        names.append(name)
        contexts.append(mix64(windows.of(place - front, place + onward) + (front * 64 + onward).astype(np.uint64)) ^ name)
    return np.concatenate(names), np.concatenate(contexts)


def _induce(rows: pd.DataFrame) -> pd.DataFrame:
    """For each group's tuples the least doc_id of each window around them: one if all windows agree, else all."""
    sides = [loose(b, np.uint8).reshape(-1, 2).astype(np.int64) for b in rows["sides"]]
    texts = [loose(b, np.uint8).reshape(-1, _LEAD + LENGTH) for b in rows["text"]]
    named = [_named(x, t) for x, t in zip(sides, texts, strict=True)]
    sent = [c for _, c in named]
    name, context = (np.concatenate(x) for x in zip(*named, strict=True))
    sides, doc = np.concatenate(sides), np.concatenate([loose(b, np.int64) for b in rows["doc"]])
    order = np.lexsort((doc, context))
    one = order[np.concatenate([[True], context[order][1:] != context[order][:-1]])]
    context, name, sides, doc = (x[one] for x in (context, name, sides, doc))
    _, kind, size = np.unique(name, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(size[kind] > 1)
    text = np.concatenate(texts)[one[mixed]]
    del texts
    least = np.full((len(mixed), _LEAD + 1), NO_ID, np.int64)
    if len(mixed):
        value, row, back = [], [], []
        for at in range(0, len(mixed), _ROWS):
            part, own = text[at : at + _ROWS], mixed[at : at + _ROWS]
            windows = Windows(np.ascontiguousarray(part).reshape(-1))
            r, b = np.nonzero((np.arange(_LEAD + 1) <= sides[own, :1]) & (LENGTH - np.arange(_LEAD + 1) <= sides[own, 1:]))
            start = r * (_LEAD + LENGTH) + _LEAD - b
            value.append(mix64(windows.of(start, start + LENGTH) ^ mix64(name[own][r] + b.astype(np.uint64))))
            row.append((r + at).astype(np.int32))
            back.append(b.astype(np.int8))
        value, row, back = np.concatenate(value), np.concatenate(row), np.concatenate(back)
        order = np.argsort(value, kind="stable")
        row, back, value = row[order], back[order], value[order]
        heads = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else order
        if len(heads):
            best = np.minimum.reduceat(doc[mixed][row], heads)
            least[row, back] = np.repeat(best, np.diff(np.concatenate([heads, [len(value)]])))
    number = np.full(len(context), -1)
    number[mixed] = np.arange(len(mixed))
    out = []
    for g, x in zip(rows["g"], sent, strict=True):
        at = np.searchsorted(context, x)
        several = number[at] >= 0
        out.append((g, x[~several].tobytes(), dense(doc[at[~several]]), x[several].tobytes(), dense(least[number[at[several]]])))
    return pd.DataFrame(out, columns=["g", "same", "same_doc", "mixed", "mixed_doc"])


def _remove(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    group = Group(rows)
    starts = np.zeros(len(group.data) + 1, np.int32)
    same = mixed = None
    if len(answers):
        x = np.concatenate([np.frombuffer(b, np.uint64) for b in answers["same"]])
        d = np.concatenate([loose(b, np.int64) for b in answers["same_doc"]])
        y = np.concatenate([np.frombuffer(b, np.uint64) for b in answers["mixed"]])
        e = np.concatenate([loose(b, np.int64).reshape(-1, _LEAD + 1) for b in answers["mixed_doc"]])
        order, other = np.argsort(x), np.argsort(y)
        same, mixed = (x[order], d[order]), (y[other], e[other])
    if same is not None:
        for place, _, owner, context, front, onward in sampled(group, True):
            doc = group.ids[owner]
            if len(same[0]):
                at = np.minimum(np.searchsorted(same[0], context), len(same[0]) - 1)
                hit = (same[0][at] == context) & (same[1][at] < doc) & (front + onward >= LENGTH)
                np.add.at(starts, (place - front)[hit], 1)
                np.add.at(starts, (place + onward - LENGTH + 1)[hit], -1)
            if len(mixed[0]):
                at = np.minimum(np.searchsorted(mixed[0], context), len(mixed[0]) - 1)
                hit = np.flatnonzero(mixed[0][at] == context)
                row, back = np.nonzero(mixed[1][at[hit]] < doc[hit][:, None])
                np.add.at(starts, place[hit][row] - back, 1)
                np.add.at(starts, place[hit][row] - back + 1, -1)
    out = []
    for doc, begin, end in zip(group.ids.tolist(), group.begins.tolist(), group.ends.tolist(), strict=True):
        text, kept, removed, spans = group.bytes[begin:end], None, 0, 0
        change = starts[begin:end]
        if change.any():
            marked = np.cumsum(change) > 0
            reach = np.concatenate([np.zeros(LENGTH, np.int64), np.cumsum(marked)])
            gone = (reach[LENGTH:] - reach[:-LENGTH]) > 0
            removed = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = group.data[begin:end][~gone].tobytes()
        kept = text if kept is None else kept
        out.append((doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for) of every document.

    Matches are judged on the input and never cross documents. A null text is empty; a null doc_id comes after
    all others; rows with one doc_id don't remove each other's bytes. Texts below 50 bytes stay whole. Other
    columns are ignored; an empty table gives an empty result.
    """
    groups = max(1, -(-total_bytes(docs) // GROUP_BYTES))
    packed = pack(lean(docs), groups)
    names = packed.groupBy("g").applyInPandas(lambda rows: _names(rows, groups), "bucket int, g int, names binary")
    shared = names.groupBy("bucket").applyInPandas(_shared, "g int, names binary")
    schema = "bucket int, g int, sides binary, doc binary, text binary"
    tuples = packed.groupBy("g").cogroup(shared.groupBy("g")).applyInPandas(lambda rows, hits: _tuples(rows, hits, groups), schema)
    answers = tuples.groupBy("bucket").applyInPandas(_induce, "g int, same binary, same_doc binary, mixed binary, mixed_doc binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = packed.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(lambda rows, hits: _remove(rows, hits)[_COLUMNS[: 6 if with_text else 5]], schema if with_text else schema.replace(", kept binary", ""))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
