"""Harvesting conversations: each thread has a mark, only exchanges past it are handed to an extractor, a failure keeps the mark.

As a stream the mark, the waiting exchanges and the timers are state of the thread; as a batch the same is a join with a
table of marks. An extractor is made on the workers by a factory and takes the exchanges of a part as (i, text).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passagework.operators.tables import written

Extractor = Callable[[list[tuple[int, str]]], list[str]]
#: The state store that these streams need, as a setting of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

RUNS = "thread string, first bigint, done bigint, n int, trigger string, outcome string, items array<string>, error string"
#: Exchanges that an extractor gets at a time.
PART = 64


class TooLong(Exception):
    """An extractor raises it on a part that it would take if it were shorter."""


def in_halves(extract: Extractor, rows: list[tuple[int, str]]) -> list[str]:
    """The items of a part; one that is too long is asked for in halves, so every exchange is taken once."""
    try:
        return list(extract(rows))
    except TooLong:
        if len(rows) < 2:
            raise
        return in_halves(extract, rows[: len(rows) // 2]) + in_halves(extract, rows[len(rows) // 2 :])


class Harvester(StatefulProcessor):
    """State of a thread: its mark, its waiting exchanges, and an event-time timer for the end of its idle time.

    Waiting exchanges are handed on at a checkpoint, once there are `least` beside the newest, which may still be
    answered, and all of them when the watermark says that the thread has been idle. The mark moves only when every
    part was taken; else the exchanges wait on, and the run is tried again with the next rows or after `retry_ms`.
    Some time after the last exchange, `keep_ms`, the state goes.
    """

    def __init__(self, factory: Callable[[], Extractor], least: int, idle_ms: int, retry_ms: int, keep_ms: int):
        self.factory, self.least, self.idle_ms, self.retry_ms, self.keep_ms = factory, least, idle_ms, retry_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "done bigint, last bigint, failed int")
        self.waiting = handle.getListState("waiting", "i bigint, text string")
        self.extract = self.factory()

    def close(self) -> None:
        pass

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at))

    def _run(self, key: tuple, waiting: dict[int, str], done: int, last: int, failed: int, whole: bool) -> tuple[pd.DataFrame, int, int]:
        """(the row of the run, the mark, failures in a row) after what waits, without the newest unless whole, was tried."""
        ready = sorted(waiting)[: None if whole else -1]
        first, outcome, items, error = ready[0], "done" if whole else "checkpoint", [], None
        try:
            for at in range(0, len(ready), PART):
                items += in_halves(self.extract, [(i, waiting[i]) for i in ready[at : at + PART]])
            done, failed = ready[-1], 0
            for i in ready:
                del waiting[i]
        except Exception as e:  # noqa: BLE001 - whatever an extractor does, its thread keeps its mark
            outcome, items, error, failed = "pending", [], f"{type(e).__name__}: {e}"[:500], failed + 1
        row = {"thread": key[0], "first": first, "done": done, "n": len(ready), "trigger": "idle" if whole else "checkpoint", "outcome": outcome, "items": items, "error": error}
        return pd.DataFrame([row]), done, failed

    def _hold(self, waiting: dict[int, str], done: int, last: int, failed: int) -> None:
        self.mark.update((done, last, failed))
        self.waiting.clear()
        if waiting:
            self.waiting.put(sorted(waiting.items()))

    def _state(self) -> tuple[dict[int, str], int, int, int]:
        done, last, failed = self.mark.get() if self.mark.exists() else (-1, 0, 0)
        return {int(i): text for i, text in (self.waiting.get() if self.waiting.exists() else ())}, done, last, failed

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, done, last, failed = self._state()
        for batch in rows:
            for i, text, at in zip(batch["i"].tolist(), batch["text"].tolist(), batch["at_ms"].tolist(), strict=True):
                if i > done:
                    waiting[i] = text or ""
                last = max(last, at)
            if len(waiting) > self.least:
                run, done, failed = self._run(key, waiting, done, last, failed, whole=False)
                yield run
        self._hold(waiting, done, last, failed)
        self._timer(last + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, done, last, failed = self._state()
        if waiting:
            run, done, failed = self._run(key, waiting, done, last, failed, whole=True)
            yield run
            self._hold(waiting, done, last, failed)
        now = expiredTimerInfo.getExpiryTimeInMs()
        if failed:
            self.handle.registerTimer(int(now + self.retry_ms * 2 ** min(failed - 1, 6)))
        elif now < last + self.keep_ms:
            self.handle.registerTimer(int(last + self.keep_ms))
        else:
            self.mark.clear()
            self.waiting.clear()


def harvest(
    exchanges: DataFrame, factory: Callable[[], Extractor], delay: str = "10 minutes", least: int = 2, idle_minutes: float = 30, retry_minutes: float = 5, keep_minutes: float = 20_160
) -> DataFrame:
    """A row for each run over a thread of the stream exchanges (thread, i, text, at): what was handed on, the mark after it, items or error.

    Exchanges up to the mark are dropped, so a replay does nothing; one that comes again while it waits takes the later
    text; null texts are empty. The session needs STATE_STORE. A thread's state is its waiting exchanges, so a hot
    thread is handed on as it comes.
    """
    rows = exchanges.withWatermark("at", delay).select("thread", F.col("i").cast("bigint").alias("i"), "text", "at", F.unix_millis("at").alias("at_ms"))
    minute = lambda m: int(m * 60_000)
    processor = Harvester(factory, least, minute(idle_minutes), minute(retry_minutes), minute(keep_minutes))
    return rows.groupBy("thread").transformWithStateInPandas(processor, RUNS, "update", "eventTime")


def failures(runs: DataFrame) -> DataFrame:
    """(thread, first, n, error) of the runs that left their thread pending."""
    return runs.where("outcome = 'pending'").select("thread", "first", "n", "error")


def _ask(factory: Callable[[], Extractor], kinds: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = factory()
        for b in batches:
            got = []
            for rows in b["rows"]:
                part = [(int(r["i"]), r["text"] or "") for r in rows]
                try:
                    got.append(("done", list(extract(part)), None))
                except TooLong as e:
                    got.append(("too_long" if len(part) > 1 else "failed", [], f"TooLong: {e}"[:500]))
                except Exception as e:  # noqa: BLE001 - one part's failure is a row
                    got.append(("failed", [], f"{type(e).__name__}: {e}"[:500]))
            yield b.assign(outcome=[g[0] for g in got], items=[g[1] for g in got], error=[g[2] for g in got])

    return run


def asked(parts: DataFrame, factory: Callable[[], Extractor], most: int) -> DataFrame:
    """parts (thread, rows array<struct<i, text>>, at most `most` each) with outcome, items and error; too long ones are split in halves.

    Each round asks for the halves of the parts that were too long in the round before, dealt anew, and for nothing
    else; so there are at most log2(most) + 1 rounds, and every exchange is in one part of the result.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes)
    todo, found = parts, None
    for _ in range(math.ceil(math.log2(max(2, most))) + 2):
        got = written(todo.mapInPandas(_ask(factory, kinds), f"{kinds}, outcome string, items array<string>, error string"))
        ended, long = got.where("outcome <> 'too_long'"), got.where("outcome = 'too_long'")
        found = ended if found is None else found.unionByName(ended)
        if long.isEmpty():
            break
        half = F.ceil(F.size("rows") / 2).cast("int")
        halves = F.explode(F.array(F.slice("rows", F.lit(1), half), F.slice("rows", half + 1, F.size("rows") - half)))
        others = [c for c in parts.columns if c != "rows"]
        todo = long.select(*others, halves.alias("rows")).repartition(*others)
    return found


def harvested(exchanges: DataFrame, marks: DataFrame, factory: Callable[[], Extractor], least: int = 2, hold_newest: bool = True, part: int = PART) -> DataFrame:
    """(thread, status, done, n, items, errors) of every thread of exchanges (thread, i, text) after one run past its mark in marks (thread, done).

    The newest exchange of a thread waits unless told otherwise. A thread with fewer than `least` exchanges ready is
    'empty', one of whose parts failed is 'pending'; both keep their mark (-1 if they had none) and hand on no items.
    The others are 'done' up to their last ready exchange; items count in all. A part is a range of exchange numbers, so that no thread is gathered
    in one place; repeated rows of an exchange are handed on each; null texts are empty; rows without a thread are left out.
    """
    exchanges = exchanges.where("thread is not null")
    last = exchanges.groupBy("thread").agg(F.max("i").alias("last"))
    placed = exchanges.join(last, "thread").join(marks, "thread", "left").withColumn("done", F.coalesce("done", F.lit(-1)).cast("bigint"))
    ready = placed.where((F.col("i") > F.col("done")) & ((F.col("i") < F.col("last")) if hold_newest else F.lit(True)))
    rows = F.array_sort(F.collect_list(F.struct("i", "text"))).alias("rows")
    parts = ready.groupBy("thread", F.floor(F.col("i") / part).alias("part")).agg(rows)
    enough = ready.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tried = asked(parts.join(enough.select("thread"), "thread", "left_semi").select("thread", "rows"), factory, part)
    runs = tried.groupBy("thread").agg(
        F.sum(F.size("rows")).alias("n"), F.sum(F.size("items")).alias("items"), F.count_if(F.col("outcome") == "failed").alias("errors"), F.max(F.array_max("rows.i")).alias("upto"))
    threads = last.join(marks, "thread", "left").join(runs, "thread", "left")
    status = F.when(F.col("upto").isNull(), "empty").when(F.col("errors") > 0, "pending").otherwise("done")
    zero = F.lit(0).cast("bigint")
    good = status == "done"
    return threads.select(
        "thread", status.alias("status"), F.when(good, F.col("upto")).otherwise(F.coalesce("done", F.lit(-1))).cast("bigint").alias("done"), F.coalesce("n", zero).alias("n"),
        F.when(good, F.col("items")).otherwise(zero).alias("items"), F.coalesce("errors", zero).alias("errors"))
