import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnspark.llm import fim

from . import cases

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc, text):
    """The row of a document, with units as strings."""
    text = text or ""
    units = UNIT.findall(text)
    digits = sha(f"42:{'' if doc is None else doc}")
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, len(units), "plain", None, None, sha(text), sha(text))
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc, len(units), form, len(prefix), len(middle), sha(out), sha(text))


@pytest.mark.parametrize("step", [1, 3, 1 << 16])
@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from([" ", "\n", "\x0b", "\x1c", "\x00", "a", "bc", "é", "\U0001f600", "<P>", "<S", ">", "M>", "<"]), max_size=25).map("".join))
def test_units_are_those_of_the_expression(step, text):
    before, fim.STEP = fim.STEP, step
    try:
        units, expected = fim.Units(text), UNIT.findall(text)
        assert units.n == len(expected)
        assert units.sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [units.end(k) for k in range(units.n + 1)] == [len("".join(expected[:k])) for k in range(units.n + 1)]
    finally:
        fim.STEP = before


def test_rows_against_plain_units(spark):
    texts = ["a <P> b", "ends in blanks  \n ", " \t ", "no <S tail", "x<", "<M", cases.LONG * 20, "word " * 70_000]
    rows = [*cases.rows(), *[(100 + i, t, None, None, None, None, None) for i, t in enumerate(texts * 4)]]
    found = [tuple(r) for r in fim.digest(cases.frame(spark, rows)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(found, key=order) == sorted((plain(r[0], r[1]) for r in rows), key=order)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}


def test_outputs_of_the_operator_hold_their_parts(spark):
    docs = cases.frame(spark, [(i, f"one two  three {i}\nfour ", None, None, None, None, None) for i in range(50)])
    for r in fim.fill_in_middle(docs).collect():
        text = f"one two  three {r['doc_id']}\nfour "
        if r["form"] == "plain":
            assert r["output"] == text
        else:
            assert text[r["prefix_chars"] : r["prefix_chars"] + r["middle_chars"]] == r["output"].split("<M>")[1]


def test_no_documents(spark):
    assert fim.digest(cases.empty(spark)).collect() == []
