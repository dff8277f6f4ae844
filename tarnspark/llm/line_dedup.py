"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity in the whole corpus, and a line is indexed under
its prefix: so many of its rarest words that two lines with a Jaccard similarity of SIMILAR or more share one.
A set that only its equals can match has no prefix. Lines that meet under a word pass a length filter, a
positional filter and a filter on the parity of hashed words (a bound on the symmetric difference); what is
left is verified on the full sets. A line that has a match at an earlier place (doc_id, line number) goes.

Places and postings are exchanged in packed columns, each set once for a task's batch, so a line that makes
up a third of the corpus costs one posting for each batch and word. Under a word a line asks for its first
PARTNERS possible matches; for a line that had more and for which none of these holds, the word's list of
lines is kept, once, in chunks, and gives all of them. A word is in a prefix only where most of a line's words
are commoner still, so a list holds different sets of a few common words at worst; equal sets are one entry.
The driver holds word counts in BINS bins and a Bloom filter of MOST_BITS bits at most; both only make the join
cheaper, its result doesn't depend on them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean
from .hashing import Windows, mix64
from .packed import NO_ID, by_bucket, dense, loose

#: Bytes of text whose postings a task sends together, and bytes whose postings a bucket takes.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Blank lines, which have fewer words, stay.
WORDS = 1
#: Sets of fewer words are similar to none but their equals: 3 of 4 words are less than SIMILAR.
NEAR_WORDS = 4
PARTNERS = 8
BINS = 1 << 22
#: The filter has a bit for every eight bytes of text, within these powers of two.
LEAST_BITS, MOST_BITS = 20, 28
#: Entries of a chunk of a word's list, and of a block of lines that ask for it.
CHUNK = 1 << 16
ASKS = 1 << 12
_BIN = np.uint64(64 - 22)
#: Words of 64 bits of the parity that is compared before full sets are.
WIDE = 8
_PARTS = 64


def line_sets(texts: list[str], ids: list[int], rarity: np.ndarray):
    """Lines with a word: their places, and their words by rarity, laid end to end."""
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    turn = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
    starts, ends = turn[::2], turn[1::2]
    words = Windows(data).of(starts, ends)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    if len(breaks) < 1 << 20:
        order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (rarity[words >> _BIN].astype(np.uint64) << np.uint64(32)) | (words >> np.uint64(32)))
    else:
        order = np.lexsort((words, rarity[words >> _BIN], line))
    words, line = words[order], line[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    words, line = words[new], line[new]
    sizes = np.bincount(line, minlength=len(breaks))
    keep = sizes >= WORDS
    words = words[keep[line]]
    which = np.flatnonzero(keep)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    last_line = np.searchsorted(breaks, text_ends - 1)
    doc = np.searchsorted(last_line, which)
    first_line = np.concatenate([[0], last_line[:-1] + 1])
    return np.array(ids, np.int64)[doc], which - first_line[doc], sizes[which], words


def _identity(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, hash and parity of each set."""
    begins = np.cumsum(sizes) - sizes
    if not len(sizes):
        return begins, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x = mix64(words)
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (x & np.uint64(63)), begins)
    return begins, mix64(np.add.reduceat(x, begins) + sizes.astype(np.uint64)), parity


def _batches(batches, n: int):
    """Lists of texts and ids of about n bytes."""
    texts, ids, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist(), strict=True):
            texts.append(text)
            ids.append(doc)
            size += len(text)
            if size >= n:
                yield texts, ids
                texts, ids, size = [], [], 0
    if texts:
        yield texts, ids


def _summed(parts: DataFrame, schema: str, name: str, add) -> DataFrame:
    """The sum of the arrays of each part (part, name), streamed: a task holds its parts' sums and no more."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, b in zip(batch["part"].tolist(), batch[name].tolist(), strict=True):
                x = loose(b, np.int64 if name == "counts" else np.uint8)
                total[part] = add(total[part], x) if part in total else x
        if total:
            yield pd.DataFrame({"part": list(total), name: [dense(x) for x in total.values()]})

    return parts.repartition(_PARTS, "part").mapInPandas(run, schema)


def _rarity(rows: DataFrame) -> tuple[np.ndarray, int]:
    """For each bin of words the logarithm of how often they occur in all lines, in 12 bits; and the bytes of all texts."""

    def count(batches):
        total, size, held = np.zeros(BINS, np.uint32), 0, []

        def settle():
            found, n = np.unique(np.concatenate([*held, np.zeros(0, np.int32)]), return_counts=True)
            total[found] += n.astype(np.uint32)

        for texts, _ in _batches(batches, 1 << 20):
            data = np.frombuffer(b"\n".join(t.encode().lower() for t in texts) + b"\n", np.uint8)
            size += len(data)
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            turn = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
            held.append((Windows(data).of(turn[::2], turn[1::2]) >> _BIN).astype(np.int32))
            if len(held) == 8:
                settle()
                held = []
        settle()
        # one part more than bins need holds the size
        parts = [*total.reshape(_PARTS, -1), np.array([size])]  # a task meets fewer than 2**32 words
        yield pd.DataFrame({"part": range(_PARTS + 1), "counts": [dense(x.astype(np.int64)) for x in parts]})

    schema = "part int, counts binary"
    found = {r["part"]: loose(r["counts"], np.int64) for r in _summed(rows.mapInPandas(count, schema), schema, "counts", np.add).collect()}
    if not found:
        return np.zeros(BINS, np.uint16), 0
    counts = np.concatenate([found[k] for k in range(_PARTS)])
    return np.minimum(np.log2(counts + 1.0) * 85, 4095).astype(np.uint16), int(found[_PARTS][0])


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(mix64(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64))


def _bits(places: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    return (places >> np.uint64(64 - power)).astype(np.int64), (mix64(places) >> np.uint64(64 - power)).astype(np.int64)


def _bloom(found: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the places of all possible matches; a line too many passes it only to be dropped by a join."""
    power = min(MOST_BITS, max(LEAST_BITS, (size >> 3).bit_length()))

    def fill(batches):
        bits = np.zeros(1 << (power - 3), np.uint8)
        for batch in batches:
            for kind, c in zip(batch["kind"], batch["columns"], strict=True):
                for doc, line in {0: ((2, 3), (4, 5)), 3: ((1, 2),)}.get(kind, ()):
                    for at in _bits(_place(loose(c[doc], np.int64), loose(c[line], np.int64)), power):
                        np.bitwise_or.at(bits, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))
        parts = bits.reshape(1 << 12, -1)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            yield pd.DataFrame({"part": some, "bits": [dense(parts[i]) for i in some]})

    schema = "part int, bits binary"
    out = np.zeros((1 << 12, 1 << (power - 15)), np.uint8)
    for r in _summed(found.mapInPandas(fill, schema), schema, "bits", np.bitwise_or).collect():
        out[r["part"]] = loose(r["bits"], np.uint8)
    return out.reshape(-1)


def _passes(bloom: np.ndarray, places: np.ndarray) -> np.ndarray:
    power = (8 * len(bloom)).bit_length() - 1
    one, two = (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 for at in _bits(places, power))
    return (one & two).astype(bool)


def _postings(rows: DataFrame, rarity, buckets: int) -> DataFrame:
    """kind, bucket, columns: 0 a batch's postings of a bucket of words, 1 its first places of sets, 2 places of repeats."""

    def run(batches):
        rank = rarity.value
        for texts, ids in _batches(batches, BATCH_BYTES):
            parts, at, lines = [], 0, 0
            while at < len(texts):
                stop, n = at, 0
                while stop < len(texts) and n < 1 << 20:
                    n += len(texts[stop])
                    stop += 1
                doc, line, sizes, words = line_sets(texts[at:stop], ids[at:stop], rank)
                begins, name, parity = _identity(words, sizes)
                prefix = np.where(sizes < NEAR_WORDS, 0, sizes - (4 * sizes + 4) // 5 + 1)
                which = np.repeat(np.arange(len(doc)), prefix)
                pos = np.arange(len(which)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                parts.append((doc, line, sizes.astype(np.uint32), name, parity, which + lines, pos.astype(np.uint32), words[begins[which] + pos]))
                lines += len(doc)
                at = stop
            doc, line, sizes, name, parity, which, pos, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(doc):
                continue
            order = np.lexsort((line, doc, name))
            head = np.ones(len(order), bool)
            head[1:] = name[order][1:] != name[order][:-1]
            first = order[head]
            owner = first[np.cumsum(head) - 1]
            again = order[(doc[order] != doc[owner]) | (line[order] != line[owner])]
            out = [(2, len(texts) % buckets, [dense(doc[again]), dense(line[again])])] if len(again) else []
            out += [(1, k, [dense(name[first[x]]), dense(doc[first[x]]), dense(line[first[x]])]) for k, x in by_bucket((name[first] % np.uint64(buckets)).astype(np.int64))]
            own = np.zeros(len(doc), bool)
            own[first] = True
            which, pos, word = (x[own[which]] for x in (which, pos, word))
            for k, x in by_bucket((word % np.uint64(buckets)).astype(np.int64)):
                x = x[np.argsort(word[x])]
                w = which[x]
                out.append((0, k, [dense((word[x] >> np.uint64(32)).astype(np.uint32)), dense(name[w]), dense(parity[w]), dense(doc[w]), dense(line[w].astype(np.uint32)), dense(sizes[w]), dense(pos[x])]))
            yield pd.DataFrame(out, columns=["kind", "bucket", "columns"])

    return rows.mapInPandas(run, "kind int, bucket int, columns array<binary>")


#: What a bucket finds: columns of numbers, packed.
_FOUND = "kind int, word long, columns array<binary>"
_PAIRS = {"x": np.int64, "y": np.int64, "xdoc": np.int64, "xline": np.int64, "doc": np.int64, "line": np.int64}
_ASKED = {"y": np.int64, "doc": np.int64, "line": np.int64, "size": np.int64, "pos": np.int64, "parity": np.int64, "word": np.int64, "at": np.int64}
_PLACES = {"doc": np.int64, "line": np.int64}


def _packed(kind: int, columns: list, kinds: list, word: int = 0) -> tuple:
    return kind, word, [dense(np.ascontiguousarray(c).astype(t) if c.dtype.kind != "u" or t != np.int64 else c.astype(np.uint64).view(np.int64)) for c, t in zip(columns, kinds, strict=True)]


def _unpacked(found: DataFrame, kind: int, columns: dict) -> DataFrame:
    """The rows of a kind."""

    def run(batches):
        for batch in batches:
            for c in batch["columns"]:
                yield pd.DataFrame({name: loose(x, t) for x, (name, t) in zip(c, columns.items(), strict=True)})

    return found.where(F.col("kind") == kind).select("columns").mapInPandas(run, ", ".join(f"{name} long" for name in columns))


def _filters(x_size, x_pos, x_parity, y_size, y_pos, y_parity) -> np.ndarray:
    """Whether two sets that share their words at these positions may be similar: by length, position and parity."""
    both = x_size + y_size
    need = (4 * both + 8) // 9
    ok = 5 * np.minimum(x_size, y_size) >= 4 * np.maximum(x_size, y_size)
    ok &= np.minimum(x_size - x_pos, y_size - y_pos) >= need
    return ok & (np.bitwise_count(x_parity ^ y_parity) <= both - 2 * need)


def _matches(columns: list, bucket: int) -> pd.DataFrame:
    """Possible matches of a bucket: 0 pairs of an earlier and a later set; 3 the sets of words under which a set had more than
    PARTNERS of them, in order and in chunks; 4 such sets, with their place in that order."""
    kinds = (np.uint32, np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.uint32)
    read = lambda i: np.concatenate([loose(c[i], kinds[i]) for c in columns])
    word = read(0)
    order = np.argsort(word, kind="stable")
    same = word[order][1:] == word[order][:-1]
    several = np.zeros(len(word), bool)  # most words of a prefix are in no other line
    several[order[1:][same]] = several[order[:-1][same]] = True
    word, name, parity, doc, line, size, pos = (read(i)[several] for i in range(7))
    order = np.lexsort((line, doc, name, word))
    one = np.ones(len(order), bool)
    one[1:] = (word[order][1:] != word[order][:-1]) | (name[order][1:] != name[order][:-1])
    order = order[one]
    order = order[np.lexsort((line[order], doc[order], word[order]))]
    word, name, parity, doc, line, size, pos = (x[order] for x in (word, name, parity, doc, line, size.astype(np.int64), pos.astype(np.int64)))
    head = np.ones(len(word), bool)
    head[1:] = word[1:] != word[:-1]
    begin = np.flatnonzero(head)[np.cumsum(head) - 1] if len(word) else word
    later = np.flatnonzero(~head)
    found, more = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    earlier, own, step = [], [], 0
    while len(later):
        x = begin[later] + step
        ok = _filters(size[x], pos[x], parity[x], size[later], pos[later], parity[later])
        full = ok & (found[later] >= PARTNERS)
        more[later[full]] = True
        ok &= ~full
        earlier.append(x[ok])
        own.append(later[ok])
        found[later[ok]] += 1
        step += 1
        later = later[(begin[later] + step < later) & ~more[later]]
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (earlier, own))
    _, one = np.unique(np.stack([name[x], name[y]]), axis=1, return_index=True)
    x, y = x[one], y[one]
    out = [_packed(0, [name[x], name[y], doc[x], line[x], doc[y], line[y]], list(_PAIRS.values()))] if len(x) else []
    capped = np.flatnonzero(more)
    if len(capped):
        code = lambda i: (word[i].astype(np.int64) << 20) + bucket
        out.append(_packed(4, [name[capped], doc[capped], line[capped], size[capped], pos[capped], parity[capped], code(capped), capped - begin[capped]], list(_ASKED.values())))
        starts = np.unique(begin[capped])
        ends = np.searchsorted(word, word[starts], side="right")
        for i, end in zip(starts.tolist(), ends.tolist(), strict=True):
            for k in range(i, end, CHUNK):
                j = min(k + CHUNK, end)
                out.append(_packed(3, [*(c[k:j] for c in (name, doc, line, size, pos, parity)), np.array([k - i])], [np.int64] * 7, int(code(i))))
    return pd.DataFrame(out, columns=["kind", "word", "columns"])


def _repeats(columns: list) -> pd.DataFrame:
    """Places of a bucket's sets that are not their first."""
    name, doc, line = (np.concatenate([loose(c[i], t) for c in columns]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    order = np.lexsort((line, doc, name))
    head = np.ones(len(order), bool)
    head[1:] = name[order][1:] != name[order][:-1]
    first = order[head][np.cumsum(head) - 1]
    again = (doc[order] != doc[first]) | (line[order] != line[first])
    return pd.DataFrame([_packed(1, [doc[order][again], line[order][again]], [np.int64, np.int64])], columns=["kind", "word", "columns"])


def _joined(rows: DataFrame, rarity, buckets: int) -> DataFrame:
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        kind, columns = int(batch["kind"].iloc[0]), batch["columns"].tolist()
        if kind == 0:
            return _matches(columns, int(batch["bucket"].iloc[0]))
        if kind == 1:
            return _repeats(columns)
        doc, line = (np.concatenate([loose(c[i], np.int64) for c in columns]) for i in (0, 1))
        return pd.DataFrame([_packed(1, [doc, line], [np.int64, np.int64])], columns=["kind", "word", "columns"])

    return _postings(rows, rarity, buckets).groupBy("kind", "bucket").applyInPandas(run, _FOUND)


def _rest(found: DataFrame, open_: DataFrame) -> DataFrame:
    """All possible matches, past PARTNERS too, of the sets of ``open_`` (y). Blocks of asking sets meet chunks of their word's list."""

    def pairs(batches):
        for batch in batches:
            for columns, asks in zip(batch["columns"], batch["asks"], strict=True):
                name, _, _, size, pos, parity, start = (loose(m, np.int64) for m in columns)
                for r in asks:
                    n = min(len(name), r["at"] - int(start[0]))
                    if n > 0:
                        ok = np.flatnonzero(_filters(size[:n], pos[:n], parity[:n].view(np.uint64), r["length"], r["pos"], np.uint64(r["parity"] & 0xFFFFFFFFFFFFFFFF)))
                        yield pd.DataFrame({"x": name[ok], "y": r["y"], "doc": r["doc"], "line": r["line"]})

    asked = _unpacked(found, 4, _ASKED).withColumnRenamed("size", "length").join(open_, "y", "left_semi")
    blocks = asked.groupBy("word", F.floor(F.col("at") / ASKS).alias("block")).agg(F.collect_list(F.struct("y", "doc", "line", "length", "pos", "parity", "at")).alias("asks"))
    rows = blocks.join(found.where(F.col("kind") == 3).select("word", "columns"), "word")
    return rows.select("asks", "columns").mapInPandas(pairs, "x long, y long, doc long, line long").distinct()


def _wide_parity(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Parity of hashed words in WIDE x 64 bits, one row for each set."""
    x = mix64(words ^ np.uint64(0x5851F42D4C957F2D))
    own = x % np.uint64(WIDE)
    bit = np.uint64(1) << ((x >> np.uint64(20)) & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(own == k, bit, np.uint64(0)), begins) for k in range(WIDE)], axis=1)


def _sets(rows: DataFrame, rarity, found: DataFrame, size: int) -> DataFrame:
    """set, n, parity, words: size, wide parity and full set of all lines that may match one."""
    wanted = found.sparkSession.sparkContext.broadcast(_bloom(found, size))

    def emit(batches):
        rank, bits = rarity.value, wanted.value
        for texts, ids in _batches(batches, 1 << 20):
            raw = [t.encode() for t in texts]
            breaks = [np.concatenate([[-1], np.flatnonzero(np.frombuffer(b, np.uint8) == 10), [len(b)]]) for b in raw]
            counts = np.array([len(b) - 1 for b in breaks])
            line = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.flatnonzero(_passes(bits, _place(np.repeat(np.array(ids, np.int64), counts), line)))
            if not len(hit):
                continue
            text = np.searchsorted(np.cumsum(counts), hit, side="right")
            parts = [raw[t][breaks[t][n] + 1 : breaks[t][n + 1]].decode() for t, n in zip(text, line[hit], strict=True)]
            _, _, sizes, words = line_sets(parts, list(range(len(parts))), rank)
            begins, name, _ = _identity(words, sizes)
            name, first = np.unique(name, return_index=True)
            if len(first):
                yield pd.DataFrame({"set": name.view(np.int64), "n": sizes[first], "parity": list(_wide_parity(words, begins)[first].view(np.int64)), "words": [np.sort(words[begins[i] : begins[i] + sizes[i]]).tobytes() for i in first]})

    return rows.mapInPandas(emit, "set long, n int, parity array<long>, words binary").dropDuplicates(["set"])


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs whose wide parities allow for a match, with their distance."""
    side = lambda k: sets.select(F.col("set").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    apart = F.aggregate(F.zip_with("px", "py", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, k: s + k)
    n = F.col("nx") + F.col("ny")
    return both.withColumn("apart", apart).where(F.col("apart") <= n - 2 * F.floor((4 * n + 8) / 9)).select("x", "y", "doc", "line", "apart")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """y, doc, line of the pairs that hold on the full sets."""

    def compare(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                good.append(5 * common >= 4 * (len(a) + len(b) - common))
            yield batch.loc[np.array(good, bool), ["y", "doc", "line"]]

    both = pairs.join(sets.select(F.col("set").alias("x"), F.col("words").alias("a")), "x").join(sets.select(F.col("set").alias("y"), F.col("words").alias("b")), "y")
    return both.select("y", "doc", "line", "a", "b").mapInPandas(compare, "y long, doc long, line long").distinct()


def later_matches(docs: DataFrame) -> DataFrame:
    """doc, line of every line that has a match at an earlier place; doc is the largest long for a null doc_id.

    A null text has no lines and blank lines have no match. Other columns are ignored; an empty table gives an empty result.
    """
    context = lean(docs).sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    ranks, size = _rarity(rows)
    rarity = context.broadcast(ranks)
    found = cut(_joined(rows, rarity, max(1, -(-size // BUCKET_BYTES))))
    sets = cut(_sets(rows, rarity, found, size))
    pairs = cut(_likely(_unpacked(found, 0, _PAIRS).select("x", "y", "doc", "line").distinct(), sets))
    # a later set is compared with the likeliest earlier one first, with others only if that doesn't hold
    best = pairs.groupBy("y").agg(F.min(F.struct("apart", "x", "doc", "line")).alias("_b")).select("y", "_b.x", "_b.doc", "_b.line")
    good = cut(_verified(best, sets))
    more = cut(good.union(_verified(pairs.join(good, "y", "left_anti").select("x", "y", "doc", "line"), sets)))
    open_ = _unpacked(found, 4, _ASKED).select("y").distinct().join(more, "y", "left_anti")
    if not open_.isEmpty():
        more = more.union(_verified(_likely(_rest(found, open_), sets).select("x", "y", "doc", "line"), sets))
    return _unpacked(found, 1, _PLACES).union(more.select("doc", "line")).distinct()


def with_findings(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns of docs and one more, whose name is returned: text (what is left), n_lines, removed_lines.

    Lines are parted by line feeds; words by ASCII white space, A to Z in lower case. Blank lines
    stay. Lines are judged on the input. A null text stays null with no lines; an empty one has
    one line. A null doc_id comes after all others; rows with one doc_id share their places, so what is removed of
    one is removed of all. Columns of the input keep their values; an empty table stays empty.
    """
    doc, gone, found = fresh(docs, "doc", "gone", "found")
    lists = later_matches(docs).groupBy(F.col("doc").alias(doc)).agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias(gone))
    joined = docs.join(lists, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(doc), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    numbers = F.filter(F.coalesce(gone, F.array().cast("array<int>")), lambda i: i < F.size(lines))
    empty = F.col("text").isNull()
    out = F.struct(text.alias("text"), F.when(empty, 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(empty, F.array().cast("array<int>")).otherwise(numbers).alias("removed_lines"))
    return joined.select(*[F.col(c) for c in docs.columns], out.alias(found)), found


def remove_lines(docs: DataFrame) -> DataFrame:
    """The documents without their later lines, with n_lines, n_removed and removed_lines (numbers from 0, ascending).

    Texts are treated as ``with_findings`` says. Columns of the input keep their values, but for text and those that have one
    of the three names, which give way.
    """
    out, found = with_findings(docs)
    new = ("n_lines", "n_removed", "removed_lines")
    kept = [F.col(f"{found}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() not in new]
    numbers = F.col(f"{found}.removed_lines")
    return out.select(*kept, F.col(f"{found}.n_lines").alias("n_lines"), numbers.alias("removed_lines"), F.size(numbers).cast("long").alias("n_removed"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (comma-joined) and kept_sha256 of every document; a null text counts as empty."""
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return remove_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), kept.alias("kept_sha256"))
