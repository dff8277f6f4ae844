"""Fill-in-the-middle texts: whole texts cut at unit bounds into prefix, middle and suffix, and put in another order.

A unit is a run of anything but ASCII white space with the white space in front of it; white space at a text's end is
a unit of its own. One Aho-Corasick automaton goes once over a text and reports its events: the six blanks, at which
the class of characters changes, and the three sentinels. Between two blanks that aren't neighbours lies the end of
exactly one unit, so units are counted from the gaps of the events' places alone, and no unit is ever made into a
string. Of a text only one mark for STEP events is kept (units and place before them); the k-th unit's end is found by
the mark in front of it and one more look at the events behind that mark, so a text needs no memory beyond its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

BLANKS = " \t\n\v\f\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are cut, and those of a hundred of them whose suffix comes first.
CUT, SUFFIX_FIRST = 50, 80
SEED = "42:"
#: Events between two marks.
STEP = 1 << 16
#: Characters of output after which a batch is sent on.
SENT = 4 << 20
_BLANK, _SENTINEL = 0, 1


@cache
def automaton():
    """One for each worker process."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in BLANKS:
        found.add_word(c, _BLANK)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, _SENTINEL)
    found.make_automaton()
    return found


def blanks_from(text: str, start: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Places of the blanks from ``start`` on, STEP events at a time, each with whether a sentinel was among the events."""
    flat = chain.from_iterable(automaton().iter(text, start))
    while len(events := np.fromiter(islice(flat, 2 * STEP), np.int64).reshape(-1, 2)):
        blank = events[:, 1] == _BLANK
        yield events[blank, 0], not blank.all()


def ends_at(blanks: np.ndarray, before: int) -> np.ndarray:
    """Those of the blanks at which a unit ends: the ones with a gap in front of them. ``before``: the place of the blank before."""
    return blanks[np.diff(blanks, prepend=before) > 1]


class Units:
    """A text's units: their number ``n``, whether a sentinel occurs, and where the k-th ends."""

    def __init__(self, text: str):
        self.text, self.sentinel = text, False
        self.counts, self.places = [0], [-1]
        self.first: np.ndarray | None = None
        for blanks, sentinel in blanks_from(text, 0):
            self.sentinel |= sentinel
            if not len(blanks):
                continue
            ends = ends_at(blanks, self.places[-1])
            if self.first is None:
                self.first = ends
            self.counts.append(self.counts[-1] + len(ends))
            self.places.append(int(blanks[-1]))
        # behind the last blank there is a last unit; or the text's last blanks are one
        self.n = self.counts[-1] + (1 if text else 0)

    def end(self, k: int) -> int:
        """Characters of the first k units."""
        if k <= 0:
            return 0
        if k >= self.n:
            return len(self.text)
        mark = int(np.searchsorted(self.counts, k)) - 1
        if mark == 0:
            return int(self.first[k - 1])
        left, place = k - self.counts[mark], self.places[mark]
        for blanks, _ in blanks_from(self.text, place + 1):
            if len(blanks):
                ends = ends_at(blanks, place)
                if len(ends) >= left:
                    return int(ends[left - 1])
                left, place = left - len(ends), int(blanks[-1])
        raise AssertionError("a mark has its events behind it")


def numbers(doc_id: Column) -> list[Column]:
    """The four numbers that decide on a document: the first four groups of eight digits of a hash of its id."""
    digits = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    units = Units(text)
    if not text or units.sentinel or h[2] % 100 >= CUT:
        return units.n, "plain", None, None, text
    low, high = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    a, b = units.end(low), units.end(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SUFFIX_FIRST:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, spm, psm), prefix_chars, middle_chars, output of every document. One map over the texts.

    A null text is an empty one; an empty text, one with a sentinel and a document that isn't cut come out as they are, with
    null prefix_chars and middle_chars. A null doc_id is kept and hashed as no digits; rows that repeat come out alike; an
    empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())

    def run(batches):
        for batch in batches:
            hashes = zip(*(batch.column(f"h{i}").to_pylist() for i in range(4)), strict=True)
            rows, begin, size = [], 0, 0
            for at, (text, h) in enumerate(zip(batch.column("text"), hashes, strict=True), 1):
                rows.append(transformed(text.as_py(), h))
                size += len(rows[-1][-1])
                if size > SENT or at == batch.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, at - begin), *columns], names=["doc_id", *names])
                    rows, begin, size = [], at, 0

    h1, h2, h3, h4 = numbers(F.col("doc_id"))
    rows = lean(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h1.alias("h0"), h2.alias("h1"), h3.alias("h2"), h4.alias("h3"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a form's output was made of. A text that was cut has no sentinel, so each of them stands in its output once."""
    part = lambda after, before: F.substring_index(F.substring_index(output, before, 1) if before else output, after, -1)
    middle = part(MIDDLE, None)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame) -> DataFrame:
    """The documents' forms with hashes of their outputs and of the texts restored from these."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
