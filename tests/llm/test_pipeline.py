"""The corpus pipeline's stages, each on what the one before kept, against brute force on a small table."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnspark.llm import common, langid, tokens

from .test_dedup import brute_lines, roots, shingles
from .test_mixing_and_prints import fill

D = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table before each stage and behind the last."""
    folder, docs = tmp_path_factory.mktemp("stages"), common.documents(spark, D)
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs)
    return [df.collect() for df in found], found[0].columns


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns_stay(stages):
    tables, columns = stages
    assert all(set(rows[0].asDict()) == set(columns) for rows in tables[:-1] if rows)


def test_language_keeps_what_has_one(spark, stages):
    before, after = by_id(stages[0][0]), by_id(stages[0][1])
    model = langid._model(common.documents(spark, D)).value
    labeller = langid.Labeller(*model)
    for doc, row in before.items():
        lang, score = labeller.texts([row.text])
        assert (doc in after) == (lang[0] != langid.UNKNOWN and score[0] >= corpus_pipeline.LEAST_SCORE), doc
    assert all(after[d] == before[d] for d in after) and len(after) > 0.9 * sum(bool(langid.words(r.text)) for r in before.values())


def test_lines(stages):
    before, after = sorted(stages[0][1], key=lambda r: r.doc_id), by_id(stages[0][2])
    for row, gone in zip(before, brute_lines([(r.doc_id, r.text) for r in before]), strict=True):
        text = "\n".join(x for i, x in enumerate(row.text.split("\n")) if i not in gone)
        if gone and not re.search(WORD, text):
            assert row.doc_id not in after
        else:
            assert after[row.doc_id].text == text and after[row.doc_id].n_chars == len(text) and after[row.doc_id].source == row.source


def test_near_copies(stages):
    before, after = sorted(stages[0][2], key=lambda r: r.doc_id), by_id(stages[0][3])
    sets = [shingles(r.text, 5) for r in before]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    first = roots(len(sets), pairs)
    assert set(after) == {r.doc_id for i, r in enumerate(before) if first[i] == i}


def test_mixture(stages):
    before, after = by_id(stages[0][3]), stages[0][4]
    size = {d: len(re.findall(WORD, r.text)) for d, r in before.items()}
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, r in before.items():
        sizes[r.source] += size[d]
    for r in after:
        assert r == before[r.doc_id]
        taken[r.source] += size[r.doc_id]
        times[r.doc_id] += 1
    want = fill(dict(sizes))
    assert max(times.values()) <= 2
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(size[d] for d, r in before.items() if r.source == source)


def test_sequences(stages):
    before, pieces = stages[0][4], stages[0][5]
    tokenizer = tokens.tokenizer(tokens.default_path())
    want, got, sequences = defaultdict(int), defaultdict(int), defaultdict(list)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in before}
    for r in before:
        want[r.doc_id] += len(ids[r.doc_id])
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        got[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 4096
    padded = sum(0 if (n := sum(x for _, x in parts)) & (n - 1) == 0 else 4096 - n for parts in sequences.values())
    assert padded == 0


def test_run_gives_the_last_stages_rows(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    docs = common.documents(spark, D).where(F.col("doc_id") % 5 == 0)
    once = sorted(key(r) for r in corpus_pipeline.sequences(spark, docs, D).collect())
    assert once == sorted(key(r) for r in corpus_pipeline.sequences(spark, docs, D).collect())
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, D).columns == corpus_pipeline.sequences(spark, docs, D).columns
