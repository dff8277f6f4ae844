"""MinHash near-dedup with an LSH forest, links confirmed on full shingle sets.

Each document's shingle set has a label of DEEP minimum hashes in each of TREES trees. A tree is the sorted order of
its labels: neighbours whose longest common prefix has START minima or more are candidates, so a run of such
neighbours is a region of the tree. The order is made by one range-partitioned sort, from which every member of a run is linked
to the run's first; the driver joins runs across partitions from the partitions' outermost rows. The components
of these links are candidate clusters. Inside a cluster documents are parted by how many of all their minima
agree, and what is left together is decided on full shingle sets. Documents with the same set are one node
throughout. Texts are shuffled once, to their clusters; the sets never are.

How deep a region goes depends on how crowded it is: a cluster too large for a task is parted by its regions, and a
region too large for a task goes on to deeper prefixes, whose runs are its blocks. Blocks meet two by two, so all that share START
minima are compared whatever the depth.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, shuffle_width
from .components import components
from .hashing import mix64, shingle_sets

TREES, START, DEEP = 24, 6, 8
#: Documents of a cluster that one task compares, or of two blocks of a region.
CLUSTER = 20_000
#: Clusters up to this size are parted many to a task.
SMALL, DEAL = 64, 4000
#: Share of all minima in which two documents have to agree before their sets are compared. At a similarity of 80 %
#: the share is 80 % with a deviation of 2.9 %, so this loses one pair in a thousand million.
AGREE = 0.62

_rng = np.random.default_rng(3)
_TIMES = _rng.integers(0, 1 << 63, size=TREES * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, size=TREES * DEEP, dtype=np.uint64)
_SIGN = np.uint64(1 << 63)
_REST = np.uint64(64 - 8 * START)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the set under each hash function."""
    best = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        x = hashes[None, at : at + 2048] * _TIMES[:, None]
        x += _PLUS[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def labels(hashes: np.ndarray) -> np.ndarray:
    """The label in each tree: a byte of each minimum's hash, the first on top, as a number whose signed order is the label's."""
    bytes_ = (mix64(signature(hashes)) >> np.uint64(56)).reshape(TREES, DEEP)
    shifts = np.arange(56, 56 - 8 * DEEP, -8, dtype=np.uint64)
    return ((bytes_ << shifts).sum(axis=1, dtype=np.uint64) ^ _SIGN).view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash, labels: their hashes, null for an empty set."""

    def run(batches):
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for at in range(0, len(texts), 500):
                rows = []
                for doc, s in zip(ids[at : at + 500], shingle_sets(texts[at : at + 500], size), strict=True):
                    rows.append((doc, len(s), f"{int(s.sum()):016x}{int(np.bitwise_xor.reduce(mix64(s))):016x}" if len(s) else None, labels(s) if len(s) else None))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hash", "labels"])

    return docs.mapInPandas(run, "doc_id long, n_shingles long, set_hash string, labels array<long>")


def label_rows(nodes: DataFrame, *keys: str) -> DataFrame:
    """node, labels -> a row (tree, label, node and the keys) for each tree."""
    return nodes.select(F.posexplode("labels").alias("tree", "label"), "node", *keys)


def sorted_links(rows: DataFrame) -> DataFrame:
    """tree, label, node -> a, b: each node with the first of its run in each tree's order, where that is another."""

    def run(batches):
        part, head, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            tree, label, node = (batch[c].to_numpy() for c in ("tree", "label", "node"))
            if not len(node):
                continue
            before_tree = np.concatenate([[tree[0] if last is None else last[0]], tree[:-1]])
            before = np.concatenate([[label[0] if last is None else last[1]], label[:-1]]).astype(np.int64)
            new = (tree != before_tree) | (((label.view(np.uint64) ^ before.view(np.uint64)) >> _REST) != 0)
            new[0] |= last is None
            first = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            heads = np.where(first >= 0, node[np.maximum(first, 0)], -1 if head is None else head)
            far = heads != node
            yield pd.DataFrame({"part": part, "kind": 0, "tree": 0, "label": 0, "a": node[far], "b": heads[far]})
            if last is None:
                yield pd.DataFrame({"part": [part], "kind": [1], "tree": [tree[0]], "label": [label[0]], "a": [node[0]], "b": [0]})
            head, last = heads[-1], (tree[-1], label[-1], node[-1])
        if last is not None:
            yield pd.DataFrame({"part": [part], "kind": [2], "tree": [last[0]], "label": [last[1]], "a": [last[2]], "b": [0]})

    order = ["tree", "label", "node"]
    ordered = rows.select(*order).repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    found = cut(ordered.mapInPandas(run, "part int, kind int, tree int, label long, a long, b long"))
    # two rows of each partition: where one partition's run goes on in the next
    ends = sorted(found.where("kind > 0").select("part", "kind", "tree", "label", "a").collect())
    joins = [(y.a, x.a) for x, y in zip(ends[1::2], ends[2::2], strict=False) if x.tree == y.tree and ((x.label ^ y.label) & ((1 << 64) - 1)) >> int(_REST) == 0]
    links = found.where("kind = 0").select("a", "b")
    return links.union(rows.sparkSession.createDataFrame(joins, "a long, b long")) if joins else links


def candidate_clusters(rows: DataFrame) -> DataFrame:
    """tree, label, node -> node, component for nodes that share a region."""
    return components(sorted_links(rows).distinct())


def region_parts(large: DataFrame) -> DataFrame:
    """tree, label, node, component -> part, node: the regions, so dealt that any two nodes of a region share a part of about CLUSTER at most."""
    prefix = lambda depth: F.shiftrightunsigned("label", 64 - 8 * depth)
    rows = large.withColumn("region", prefix(START))
    key = ["component", "tree", "region"]
    regions = rows.groupBy(*key).agg(F.count("*").alias("members")).where(F.col("members") > 1)
    blocks = F.when(F.col("members") <= CLUSTER, 1).otherwise(F.ceil(2 * F.col("members") / CLUSTER)).cast("int")
    rows = rows.join(regions.withColumn("blocks", blocks), key)
    # a crowded region goes to its deepest prefixes; one that is still too crowded is dealt by node
    crowded = rows.where(F.col("blocks") > 1).groupBy(*key, "label").agg(F.count("*").alias("alike")).where(F.col("alike") > CLUSTER / 4).select(*key, "label", F.lit(True).alias("split"))
    rows = rows.join(crowded, [*key, "label"], "left")
    own = F.when(F.col("split"), F.xxhash64("label", "node")).otherwise(F.xxhash64("label"))
    rows = rows.withColumn("own", F.pmod(own, "blocks").cast("int"))
    # each block with each other one; the only block of a region with itself
    rows = rows.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("own")) | (F.col("blocks") == 1))))
    return rows.select(F.concat_ws("-", "component", "tree", "region", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "node")


def compared_parts(rows: DataFrame) -> DataFrame:
    """tree, label, node -> part, deal, node: all that share a region in some tree have a part in common; a deal is a task's share of parts."""
    clusters = cut(candidate_clusters(rows))
    sized = clusters.join(clusters.groupBy("component").agg(F.count("*").alias("members")), "component")
    name, size_of = F.concat(F.lit("c"), F.col("component").cast("string")), F.col("members")
    deals = max(1, clusters.count() // DEAL)
    whole = sized.where(size_of <= CLUSTER).select(name.alias("part"), F.when(size_of <= SMALL, F.concat(F.lit("d"), F.pmod(F.xxhash64("component"), F.lit(deals)).cast("string"))).otherwise(name).alias("deal"), "node")
    regions = region_parts(rows.join(sized.where(size_of > CLUSTER).select("node", "component"), "node")).distinct()
    return whole.union(regions.select("part", F.col("part").alias("deal"), "node"))


def reach(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n the first of its component; near(i, those not reached yet) says which of these i links to."""
    root, open_ = np.full(n, -1), np.arange(n)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        queue = [seed]
        open_ = open_[root[open_] < 0]
        while queue and len(open_):
            found = near(queue.pop(), open_)
            hit = open_[found]
            if len(hit):
                root[hit] = seed
                queue += hit.tolist()
                open_ = open_[~found]
    return root


def alike(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """part, deal, node -> part, node: the parts again, parted by how far all minima agree; who is left alone is out."""

    def split(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["part", "node"])
        marks = np.ascontiguousarray(np.stack(batch["labels"].to_numpy()).astype(np.int64)).view(np.uint8)
        least, names, kept = AGREE * marks.shape[1], batch["part"].to_numpy(), []
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        for begin, end in zip(cuts, cuts[1:], strict=False):
            own = marks[begin:end]
            root = reach(end - begin, lambda i, open_, own=own: (own[open_] == own[i]).sum(axis=1) >= least)
            several = np.bincount(root, minlength=end - begin)[root] > 1
            kept += [(f"{names[begin]}/{r}", begin + int(i)) for i, r in zip(np.flatnonzero(several), root[several], strict=True)]
        ids = batch["node"].to_numpy()
        return pd.DataFrame({"part": pd.Series([p for p, _ in kept], dtype=object), "node": [ids[i] for _, i in kept]})

    return parts.join(nodes, "node").groupBy("deal").applyInPandas(split, "part string, node long")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of the first set of its component; links have 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    held: list = [None, None, None]  # the sets that are open, laid end to end; they are gathered anew when many have gone

    def near(i: int, open_: np.ndarray) -> np.ndarray:
        if held[0] is None or len(open_) < 0.7 * len(held[0]):
            held[0], held[1] = open_, np.concatenate([ids[begins[j] : begins[j] + sizes[j]] for j in open_])
            held[2] = np.cumsum(sizes[open_]) - sizes[open_]
        own = ids[begins[i] : begins[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[held[1]], held[2])[np.searchsorted(held[0], open_)]
        mark[own] = 0
        return 100 * common >= percent * (sizes[i] + sizes[open_] - common)

    return reach(len(sets), near)


def confirmed(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """part, node -> a, b: each document with the first of its confirmed component in its part. All texts of a doc_id take part."""

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"])
        found = shingle_sets(batch["text"].tolist(), size)
        some = np.flatnonzero([len(s) > 0 for s in found])
        ids = batch["doc_id"].to_numpy()[some]
        root = linked([found[i] for i in some], percent) if len(some) else some
        far = ids[root] != ids
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    texts = members.withColumnRenamed("node", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    return texts.groupBy("part").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Words are split at ASCII white space, A to Z in lower case. Documents link if their sets of shingles of
    ``size`` words have a Jaccard similarity of ``percent`` hundredths or more. A text of fewer words is one
    shingle; a null or blank one has an empty set, links with nothing and is kept. Rows with a null doc_id
    get a null component and are kept; repeated rows of a doc_id are all returned and stand for one document
    with the union of links of their texts. Other columns are ignored; an empty table gives an empty result.
    """
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = cut(signatures(rows.where(F.col("doc_id").isNotNull()), size))
    # documents with one set are one node: the smallest of their ids
    classes = known.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(F.min(F.struct("doc_id", "labels")).alias("_m"))
    nodes = cut(classes.select("set_hash", F.col("_m.doc_id").alias("node"), F.col("_m.labels").alias("labels")))
    parts = alike(compared_parts(label_rows(nodes)), nodes.select("node", "labels"))
    texts = rows.where(F.col("doc_id").isNotNull())
    links = confirmed(cut(parts), texts, size, percent)
    # rows that share a set, or a doc_id, belong together as well
    same = known.where(F.col("set_hash").isNotNull()).select("doc_id", "set_hash").join(nodes.select("set_hash", "node"), "set_hash")
    group = components(links.union(same.where(F.col("doc_id") != F.col("node")).select("doc_id", "node")))
    out = known.select("doc_id", "n_shingles").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    odd = signatures(rows.where(F.col("doc_id").isNull()), size).select("doc_id", "n_shingles", "doc_id")
    return out.union(odd).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate group left: the rows of the smallest doc_id. Rows without a doc_id stay."""
    (gone,) = fresh(docs, "gone")
    out = near_duplicates(docs, size, percent)
    others = out.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")
