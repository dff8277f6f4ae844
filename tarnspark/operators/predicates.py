"""Filters put together from options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(df: DataFrame, options: dict[str, object], need_one: bool = True) -> DataFrame:
    """Rows that fit all options that are set.

    An option is named by its column, or column and test: eq (the default), in, not_in (null columns go), like, ilike, least,
    most, between, null, missing_or_not. Options that are None are left out; if none is set that is an error, as it would
    mean the whole table, unless ``need_one`` is false.
    """
    tests = {
        "eq": lambda c, v: c == F.lit(v),
        "in": lambda c, v: c.isin(*v),
        "not_in": lambda c, v: c.isNotNull() & ~c.isin(*v),
        "like": lambda c, v: c.like(v),
        "ilike": lambda c, v: c.ilike(v),
        "least": lambda c, v: c >= F.lit(v),
        "most": lambda c, v: c <= F.lit(v),
        "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
        "null": lambda c, v: c.isNull() if v else c.isNotNull(),
        "missing_or_not": lambda c, v: c.isNull() | (c != F.lit(v)),
    }
    found: list[Column] = []
    for name, value in options.items():
        if value is not None:
            column, _, test = name.partition("__")
            found.append(tests[test or "eq"](F.col(column), value))
    if need_one and not found:
        raise ValueError("no option is set")
    return df.where(reduce(lambda a, b: a & b, found)) if found else df
