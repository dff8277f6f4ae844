"""A prioritised queue with leases and a budget of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT

LEASE_MINUTES, ATTEMPTS, MOST = 15, 5, 50


def open_messages(queue: DataFrame, now: Column) -> DataFrame:
    """Messages that may be leased: not completed, not leased within the lease's time, and not tried too often."""
    stale = F.col("started").isNull() | (F.col("started") < now - F.make_dt_interval(mins=F.lit(LEASE_MINUTES)))
    return queue.where(F.col("completed").isNull() & stale & (F.col("attempts") < ATTEMPTS))


def lease(queue: DataFrame, now: Column, allowance: int | Column, webhook_priority: int = 1, most: int = MOST) -> DataFrame:
    """Messages of a run, by priority and age: all webhooks, and others as far as the allowance goes, ``most`` in all."""
    found = open_messages(queue, now)
    counts = found.agg(F.count("*").alias("_all"), F.count_if(F.col("priority") == webhook_priority).alias("_hooks"))
    room = counts.select(F.least(F.lit(most), F.col("_all"), F.col("_hooks") + (F.lit(allowance) if isinstance(allowance, int) else allowance)).cast("int").alias("n")).first()["n"]
    taken = found.orderBy("priority", "created", "id").limit(room)
    return taken.withColumn("started", now).withColumn("attempts", F.col("attempts") + 1)


def complete(queue: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """queue after results (id, error): without an error a message is complete, with one its lease ends and the error is kept."""
    joined = queue.join(done.select("id", F.col("error").alias("_error"), F.lit(True).alias("_done")), "id", "left")
    good = F.col("_done") & F.col("_error").isNull()
    bad = F.col("_done") & F.col("_error").isNotNull()
    kind = lambda c: queue.schema[c].dataType
    changed = {"completed": F.when(good, now).otherwise(F.col("completed")), "started": F.when(bad, F.lit(None)).otherwise(F.col("started")), "error": F.when(bad, F.col("_error")).otherwise(F.col("error"))}
    return joined.select(*[changed[c].cast(kind(c)).alias(c) if c in changed else F.col(c) for c in queue.columns])


def decode_push(rows: DataFrame, column: str = "data") -> DataFrame:
    """base64 JSON messages as columns, with the reason why one is refused."""
    text = F.trim(F.unbase64(column).cast("string"))
    message = F.from_json(text, "id long, action string, created string, started string, completed string, json_data string, is_webhook boolean")
    out = rows.withColumn("message", message)
    reason = F.when(F.col(column).isNull(), "no data").when(F.col("message").isNull() | F.col("message.action").isNull(), "no action").when(F.col("message.json_data").isNull(), "no payload")
    return out.withColumn("reason", reason)


def route(rows: DataFrame, column: str = "json_data") -> DataFrame:
    """Events of messages with their route (create, update, delete) or the reason why they have none. An id of 0 counts as missing."""
    event = F.from_json(column, EVENT)
    out = rows.withColumn("event", event)
    missing = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    known = F.col("event.aspect_type").isin("create", "update", "delete")
    reason = F.when(F.col(column).isNull() | F.col("event").isNull(), "bad payload").when(missing("event.object_id") | missing("event.owner_id"), "missing id").when(~F.coalesce(known, F.lit(False)), "unknown action")
    return out.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNull(), F.col("event.aspect_type")))


def usage(header: Column) -> tuple[Column, Column]:
    """Short-term and daily usage of an "a,b" header."""
    return tuple(F.split_part(header, F.lit(","), F.lit(k)).try_cast("int") for k in (1, 2))
