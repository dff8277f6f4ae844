"""Every query against the SQL beside it, on the smallest tables."""

import math
import re

import duckdb
import pytest

from tarnspark.plans import lens
from tarnspark.plans import queries as plans

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, D)
    rel = duck.execute(plans.SQL[name])
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want)


def test_every_query_has_a_row_or_a_schema(spark):
    import __spark_entry__ as entry

    assert set(plans.SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_one_to_one_takes_all_customers(spark):
    d = "/root/testdata/sf0.01"
    got = plans.QUERIES["match_one_to_one"](spark, d).select("ext_id", "outcome").collect()
    keys = [r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect()]
    assert len(keys) > 500 and sorted(r.ext_id for r in got) == sorted(keys)
    assert {r.ext_id for r in got if r.outcome == "skipped"} == {k for k in keys if k % 17 == 0}


def test_ledger_tasks_follow_the_lines(spark, duck, monkeypatch):
    """More lines, more tasks: joins and the pairs of user and site are in 61 parts, and results stay."""
    lines = duck.execute("SELECT count(*) FROM lineitem").fetchall()[0][0]
    monkeypatch.setattr(lens, "LINES", -(-lines // 61), raising=False)
    found = plans.QUERIES["ledger_union_history"](spark, D)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(rf"hashpartitioning\({key}[^)]*, 61\)", plan) for key in ("l_orderkey", "o_orderkey", "user_id#\\d+L?, site_id"))
    want = duck.execute(plans.SQL["ledger_union_history"]).fetchall()
    assert sorted(map(tuple, found.select("user_id", "n", "with_activity", "sites").collect())) == sorted(want)


def test_headings_with_entities_equal_sql(spark, tmp_path):
    """Entities of all kinds, tags within a heading, and pages without one."""
    heads = ["<h1>a &amp; b</h1>", "<h1>say &quot;x&quot; &lt;y&gt; &apos;z&#39;</h1>", '<H1 class="t">\n two <b>words</b>&nbsp;</H1>', "<title>only &deg; this</title>", "<h1> </h1><title>t</title>", "<p>none</p>", "<h1>x<script>var a = 1;</script>y &amp;quot;</h1>", "<h1>first</h1><h1>second</h1>"]
    spark.createDataFrame([(i, f"<ul><li>1</li></ul>{h}") for i, h in enumerate(heads)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(plans.SQL["page_headings"]).fetchall())
    got = sorted((r.page_id, r["items"], r["name"]) for r in plans.QUERIES["page_headings"](spark, str(tmp_path)).collect())
    assert got == want
    assert [r[2] for r in got] == ["a & b", "say \"x\" <y> 'z'", "two words", "only ° this", "t", None, "x y &quot;", "first"]
