"""Streams give what the batch gives."""

import json

from pyspark.sql import functions as F

from tarnspark.sources import readers
from tarnspark.streaming import events


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_ingest_reads_each_event_once(spark, tmp_path):
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    body = {"aspect_type": "create", "event_time": 1700000000, "object_id": 5, "object_type": "activity", "owner_id": 9, "subscription_id": 1}
    (source / "a.json").write_text(json.dumps(body) + "\n" + json.dumps(json.dumps(body)) + "\n")
    for _ in range(2):
        events.ingest(readers.webhook_events(spark, str(source)), str(out), str(mark)).awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert len(rows) == 2 and all(r.priority == 1 and r.is_webhook and r.action == "create" and r.user_id == "9" for r in rows)


def test_repeated_deliveries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id int, ts string").select("id", F.to_timestamp("ts").alias("ts"))
    rows.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "d"))
    assert drain(events.once(stream, ["id"], "ts"), "once").count() == 2


def test_visits_with_state(spark, tmp_path):
    track = [(0, 10.0), (30, 5.0), (60, 200.0), (300, 300.0), (400, 8.0), (420, 9.0), (2000, 500.0)]
    rows = spark.createDataFrame([("t", "s", float(t), d, 100.0, 150.0) for t, d in track], "track_id string, site_id string, t double, dist double, enter double, leave double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1700000000))
    rows.coalesce(1).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))
    got = sorted((r.start, r.end, r.samples, r.min_dist) for r in drain(events.visit_states(stream), "visits_state").collect())
    assert got == [(0.0, 30.0, 2, 5.0), (400.0, 420.0, 2, 8.0)]


def test_routes(spark):
    import base64

    message = lambda **x: base64.b64encode(json.dumps(x).encode()).decode()
    event = json.dumps({"aspect_type": "update", "object_id": 1, "owner_id": 2})
    rows = [(1, message(action="x", json_data=event)), (2, message(json_data=event)), (3, None), (4, message(action="x", json_data=json.dumps({"aspect_type": "fly", "object_id": 1, "owner_id": 2}))), (5, base64.b64encode(b"nonsense").decode())]
    got = {r.id: (r.route, r.reason) for r in events.routed(spark.createDataFrame(rows, "id int, data string")).collect()}
    assert got == {1: ("update", None), 2: (None, "no action"), 3: (None, "no data"), 4: (None, "unknown action"), 5: (None, "no action")}
