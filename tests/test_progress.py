"""What came before an activity: repeated visits need no step of their own."""

from tarnspark.operators import progress


def test_prior_places_and_heights(spark):
    seen = spark.createDataFrame([(1, 10, 100, 1), (1, 10, 99, 2), (1, 10, None, 3), (1, 11, 100, 4), (2, 12, 200, 5), (1, 12, 98, 6), (1, 12, 98, 7)], "user_id int, site_id int, activity_id int, ts int")
    now = spark.createDataFrame([(1, 100), (2, 200)], "user_id int, activity_id int")
    sites = spark.createDataFrame([(10, 5.0, "A", "x"), (11, 9.0, "B", "x"), (12, 7.0, None, "y"), (13, None, None, None)], "site_id int, elevation double, state string, country string")
    highest, places = progress.prior_highest(seen, now, sites), progress.prior_places(seen, now, sites)
    assert [tuple(r) for r in highest.collect()] == [(1, 100, 7.0)]
    assert sorted(map(str, places.collect())) == ["Row(user_id=1, current_id=100, state='A', country='x')", "Row(user_id=1, current_id=100, state=None, country='y')"]
    # rows of (user, activity, site) aren't aggregated on the way
    grouped = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert grouped(highest) == 1 and grouped(places) == 1


def test_visit_counts(spark):
    seen = spark.createDataFrame([(1, 10, 100), (1, 10, None), (1, 11, 100), (1, None, 7), (2, None, None)], "user_id int, site_id int, activity_id int")
    assert sorted(map(tuple, progress.visit_counts(seen, 3).collect())) == [(1, 4, 3, 2), (2, 1, 0, 0)]
