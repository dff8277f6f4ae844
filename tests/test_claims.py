"""Claims over tiles, against one pass over all seeds."""

import pandas as pd

from tarnspark.operators import claims

ROWS = "seed_id string, elevation double, rank int, lat double, lng double"


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS)
    want = claims._settle(pd.DataFrame(rows, columns=["seed_id", "elevation", "rank", "lat", "lng"]), 50.0)
    got = claims.in_rounds(df, 50.0, **options).collect()
    assert sorted((r.seed_id, r["rank"], r.collided) for r in got) == sorted(want.itertuples(index=False, name=None))
    return want


def test_a_chain_of_waiting_seeds_takes_a_round_for_each_border(spark, monkeypatch):
    # each seed waits for the one before it; by rounds of those that come first that is a round for each seed
    rows = [(f"s{i:03}", 1000.0 - i, r, 40.0 + i * 0.00036 + r * 0.0002, -105.0) for i in range(300) for r in (1, 2, 3)]
    calls, cut = [], claims.cut
    monkeypatch.setattr(claims, "cut", lambda df: calls.append(1) or cut(df))
    want = check(spark, rows)
    assert len(calls) <= 20 and len(set(want["rank"])) > 1


def test_estimates_do_not_double_with_the_rounds(spark, monkeypatch):
    # what the planner thinks of a round's rows has a few digits more than of the last one's, not twice as many
    rows = [(f"s{i:03}", 1000.0 - i, r, 40.0 + i * 0.00036 + r * 0.0002, -105.0) for i in range(600) for r in (1, 2)]
    digits, cut = [], claims.cut

    def watched(df):
        if df.columns == ["seed_id", "claim", "collided"]:
            digits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return cut(df)

    monkeypatch.setattr(claims, "cut", watched)
    check(spark, rows, most=20)
    steps = [b - a for a, b in zip(digits, digits[1:], strict=False)]
    assert len(steps) >= 4 and max(steps) <= 2 * digits[0]
