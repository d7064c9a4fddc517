"""Streaming forms: exactly-once intake, idle sessions, high-water marks, incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_key(client: Column, session: Column, native: Column) -> Column:
    """SHA-256 of the JSON list [client, session, id], one blank after each comma."""
    parts = [F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "") for c in (client, session, native)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256)


def once(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the watermark; later replays are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def with_verdicts(events: DataFrame, key: str, body: str, time: str, delay: str) -> DataFrame:
    """(key, verdict, n): per trigger how many deliveries of a key were accepted, replays, or conflicts with the first body.

    State is one digest a key and goes when the watermark passes the delay after its last event.
    """
    digested = events.withWatermark(time, delay).select(F.col(key).alias("key"), F.sha2(F.col(body), 256).alias("digest"), F.col(time).alias("at"))

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        counts = {"accepted": 0, "replay": 0, "conflict": 0}
        for b in batches:
            for digest in b.sort_values(["at", "digest"])["digest"]:
                if first is None:
                    first = digest
                    counts["accepted"] += 1
                else:
                    counts["replay" if digest == first else "conflict"] += 1
        state.update((first,))
        if state.getCurrentWatermarkMs() >= 0:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1_000)
        rows = [(group[0], v, n) for v, n in counts.items() if n]
        yield pd.DataFrame(rows, columns=["key", "verdict", "n"])

    return digested.groupBy("key").applyInPandasWithState(update, "key string, verdict string, n bigint", "digest string", "update", GroupStateTimeout.EventTimeTimeout)


def first_deliveries(events: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """(key, body, deliveries, replays, refused) of a batch: the first delivery of each key holds; equal ones after it are replays, others are refused.

    Deliveries are counted by key and body digest first, so a key that is sent very often meets nowhere.
    """
    each = events.groupBy(key, F.sha2(body, 256).alias("_digest")).agg(F.min(F.struct(order, F.col(body).alias("body"))).alias("_f"), F.count(F.lit(1)).alias("_n"))
    whole = each.groupBy(key).agg(F.min("_f").alias("_f"), F.sum("_n").alias("deliveries"), F.min_by("_n", "_f").alias("_same"))
    return whole.select(key, F.col("_f.body").alias("body"), "deliveries", (F.col("_same") - 1).alias("replays"), (F.col("deliveries") - F.col("_same")).alias("refused"))


def idle_sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of each session, once the watermark says that it has been idle for the gap."""
    counted = events.withWatermark(time, delay).groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def beyond_marks(rows: DataFrame, marks: DataFrame, group: str, order: str, hold_newest: bool = True) -> DataFrame:
    """Rows of each group past its high-water mark (group, done); the newest of a group waits for the next run."""
    last = rows.groupBy(group).agg(F.max(order).alias("_last"))
    fresh = rows.join(last, group).join(marks, group, "left").where(F.col(order) > F.coalesce("done", F.lit(-1)))
    return (fresh.where(F.col(order) < F.col("_last")) if hold_newest else fresh).drop("_last", "done")


def advanced(marks: DataFrame, handled: DataFrame, group: str, order: str) -> DataFrame:
    """The marks after the handled rows: the larger of both."""
    new = handled.groupBy(group).agg(F.max(order).alias("done"))
    return marks.unionByName(new).groupBy(group).agg(F.max("done").alias("done"))


def refresh(stream: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """Call the batch build with what each trigger brings; a failed build is tried again with the same rows."""
    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
