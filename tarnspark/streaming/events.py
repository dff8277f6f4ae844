"""The same operators over streams: ingest, routing, rate windows, de-duplication, visits with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scores import RESET_SECONDS
from ..operators.queue import decode_push, route


def ingest(events: DataFrame, path: str, checkpoint: str):
    """Append incoming queue rows to a durable table, once each, and stop when all that is there has been read."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(messages: DataFrame, column: str = "data") -> DataFrame:
    """Pushed messages with their route or the reason why they have none."""
    decoded = decode_push(messages, column)
    out = route(decoded.withColumn("json_data", F.col("message.json_data")).withColumnRenamed("reason", "_first"))
    return out.withColumn("reason", F.coalesce("_first", "reason")).withColumn("route", F.when(F.col("reason").isNull(), F.col("route"))).drop("_first")


def rate_windows(events: DataFrame, time: str, length: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Requests in each window of time; late rows count until the watermark has passed them."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("_w")).agg(F.count("*").alias("used")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "used")


def once(events: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Events without later deliveries of the same one."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


VISIT = "track_id string, site_id string, start double, end double, samples long, min_dist double"
STATE = "start double, last double, samples long, min_dist double"


def visit_states(rows: DataFrame) -> DataFrame:
    """Visits from a stream of (track_id, site_id, ts, t, dist, enter, leave), each sent when it closes.

    A visit closes when a point is beyond the leave distance and RESET_SECONDS behind the last one within reach, or
    when event time has passed that by without a point. The state of a pair is four numbers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, samples, least = state.get if state.exists else (None, None, 0, None)
        closed = []
        if state.hasTimedOut:
            closed.append((*key, start, last, samples, least))
            state.remove()
        else:
            rows = [x for batch in batches for x in zip(batch["t"].tolist(), batch["dist"].tolist(), batch["enter"].tolist(), batch["leave"].tolist(), strict=True)]
            for t, dist, enter, leave in sorted(rows):  # a trigger's rows of a pair may come in several batches
                if dist <= enter:
                    start, samples = (t, 1) if start is None else (start, samples + 1)
                    last, least = t, dist if least is None else min(least, dist)
                elif start is not None and dist >= leave and t - last >= RESET_SECONDS:
                    closed.append((*key, start, last, samples, least))
                    start, last, samples, least = None, None, 0, None
            if start is None:
                if state.exists:
                    state.remove()
            else:
                state.update((start, last, samples, least))
                state.setTimeoutTimestamp(max(int((last + RESET_SECONDS) * 1000), state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame(closed, columns=["track_id", "site_id", "start", "end", "samples", "min_dist"])

    keyed = rows.withWatermark("ts", "10 minutes").groupBy("track_id", "site_id")
    return keyed.applyInPandasWithState(step, VISIT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
