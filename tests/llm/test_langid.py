import numpy as np

from tarnspark.llm import langid

from . import cases


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    scores, moves, lengths = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), np.array([1, 4, 2])
    ids = rng.integers(5, size=7)
    got = langid.marginal_sums(ids, lengths, scores, moves)
    at = 0
    for row, n in zip(got, lengths, strict=True):
        want, total = np.zeros(3), 0.0
        for path in np.ndindex(*[3] * n):
            p = np.exp(sum(scores[ids[at + i], y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for y in path:
                want[y] += p
        assert np.allclose(row, want / total)
        at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify(docs).collect() if r.held_out]
    assert len(held) > 200 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "²½ ½ Ⅷ 12 ٣" if i == 0 else "some words here", "en") for i in range(30)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[0] == "und" and got[1] == "en" and langid.words("a²b Ⅷ ǅx ªz") == ["a", "b", "ǆx", "ªz"]


def test_more_languages_than_a_few(spark):
    syllables = [a + b for a in "bdfgklmnpr" for b in "aeiou"]
    rng = np.random.default_rng(5)
    rows = []
    for k in range(80):
        own = rng.choice(50, 5, replace=False)
        for _ in range(12):
            text = " ".join("".join(syllables[own[i]] for i in rng.integers(5, size=3)) + f"{'xyzvw'[k % 5]}{'aeiou'[k // 5 % 5]}{'hjqst'[k // 25]}" for _ in range(30))
            rows.append((len(rows), text, f"l{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: y for i, _, y in rows}
    got = langid.identify(docs).collect()
    assert len({r.lang_pred for r in got}) == 80 and np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.9


def test_labels_with_equal_sums_take_the_first_name(spark):
    docs = spark.createDataFrame([(i, "same words for both", "ba"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs).collect()} <= {"a", "b"}
    labeller = langid.Labeller(["a", "b"], np.zeros((langid.FEATURES, 2), np.float32), np.zeros((2, 2), np.float32))
    assert labeller.label([["one", "two"], []]) [0].tolist() == ["a", "und"]


def test_odd_rows(spark):
    got = {r.doc_id: r for r in langid.identify(cases.frame(spark)).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[3].lang_pred == "und" and got[0].score == 0
    assert len(got) == 12 and got[7].lang_pred in ("en", "de")
    assert langid.identify(cases.empty(spark)).count() == 0
    none = cases.frame(spark, [(i, "some words here", None, None, None, None, None) for i in range(4)])
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
