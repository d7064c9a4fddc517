import datetime as dt
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagework.streaming import harvest

# a stream's workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AT = dt.datetime(2026, 1, 1)
SCHEMA = "thread string, i int, text string, at timestamp"


def noting():
    return lambda rows: [f"{i}:{text}" for i, text in rows if text]


def picky():
    """Fails on the word bad, refuses more than three exchanges at a time."""

    def extract(rows):
        if any("bad" in t for _, t in rows):
            raise ValueError("no thanks")
        if len(rows) > 3:
            raise harvest.TooLong(len(rows))
        return [f"{i}:{t}" for i, t in rows]

    return extract


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set(*harvest.STATE_STORE)
    yield Stream(spark, str(tmp_path))
    spark.conf.unset(harvest.STATE_STORE[0])


class Stream:
    """Runs a query over a folder, stopping after each delivery and starting again from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        os.makedirs(f"{folder}/in")

    def deliver(self, rows, factory, **settings):
        self.spark.createDataFrame([(t, i, x, AT + dt.timedelta(minutes=m)) for t, i, x, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.n += 1
        out = f"{self.folder}/out{self.n}"
        read = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        write = lambda df, batch: df.write.mode("append").parquet(out)
        q = harvest.harvest(read, factory, **settings).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.folder}/c").start()
        q.processAllAvailable()
        q.stop()
        found = self.spark.read.schema(harvest.RUNS).parquet(out) if os.path.isdir(out) else self.spark.createDataFrame([], harvest.RUNS)
        return sorted((r["thread"], r["outcome"], r["done"], r["items"]) for r in found.collect())


def test_marks_over_restarts(stream):
    got = stream.deliver([("a", 0, "x", 0), ("a", 1, "y", 1), ("a", 2, "z", 2), ("b", 0, "alone", 2)], noting)
    assert got == [("a", "checkpoint", 1, ["0:x", "1:y"])]  # the newest waits, b has too little
    # a replay of what is behind the mark does nothing; the newest is answered anew while it waits
    got = stream.deliver([("a", 0, "x", 3), ("a", 1, "y", 3), ("a", 2, "z again", 4), ("c", 0, "late", 120)], noting)
    # the watermark has passed the idle time of a and b by now: the next trigger hands on what waits
    got += stream.deliver([("c", 1, "later", 121)], noting)
    assert ("a", "done", 2, ["2:z again"]) in got and ("b", "done", 0, ["0:alone"]) in got
    assert not any(t == "c" and o == "done" for t, o, *_ in got)


def test_a_failure_keeps_its_threads_mark_only(stream):
    got = stream.deliver([("a", 0, "bad", 0), ("a", 1, "y", 1), ("a", 2, "z", 2), ("b", 0, "p", 0), ("b", 1, "q", 1), ("b", 2, "r", 2)], picky)
    assert got == [("a", "pending", -1, []), ("b", "checkpoint", 1, ["0:p", "1:q"])]
    # the extractor is mended: all that waited is handed on, nothing is lost and nothing twice
    got = stream.deliver([("a", 3, "w", 3), ("b", 3, "s", 3), ("b", 4, "t", 3)], noting)
    assert got == [("a", "checkpoint", 2, ["0:bad", "1:y", "2:z"]), ("b", "checkpoint", 3, ["2:r", "3:s"])]


def test_pending_runs_are_tried_again_by_a_timer(stream):
    stream.deliver([("a", 0, "bad", 0), ("a", 1, "y", 1), ("a", 2, "z", 2)], picky)
    got = stream.deliver([("z", 0, "time passes", 200)], picky) + stream.deliver([("z", 1, "time passes", 201)], picky)
    assert ("a", "pending", -1, []) in got
    got = stream.deliver([("z", 2, "time passes", 400)], noting) + stream.deliver([("z", 3, "time passes", 401)], noting)
    assert ("a", "done", 2, ["0:bad", "1:y", "2:z"]) in got


def test_state_goes_after_its_time(stream):
    stream.deliver([("a", 0, "x", 0), ("a", 1, "y", 1), ("a", 2, "z", 2)], noting, keep_minutes=60)
    for m in (100, 101, 200, 201):
        stream.deliver([("z", m, "time passes", m)], noting, keep_minutes=60)
    got = stream.deliver([("a", 0, "new", 202), ("a", 1, "life", 202), ("a", 2, "!", 202)], noting, keep_minutes=60)
    assert ("a", "checkpoint", 1, ["0:new", "1:life"]) in got


def test_the_batch_form(spark, rows):
    said = [("a", i, f"t{i}") for i in range(9)] + [("b", 0, "bad"), ("b", 1, "x"), ("b", 2, "y")] + [("c", 0, "x"), ("c", 1, None)] + [("d", i, "w") for i in range(6)] + [(None, 0, "no thread")]
    exchanges = spark.createDataFrame(said, "thread string, i int, text string")
    marks = spark.createDataFrame([("b", 0), ("d", 1), ("e", 7)], "thread string, done int")
    # b's failing exchange lies behind its mark
    assert rows(harvest.harvested(exchanges, marks, picky, part=8)) == sorted(
        [("a", "done", 7, 8, 8, 0), ("b", "empty", 0, 0, 0, 0), ("c", "empty", -1, 0, 0, 0), ("d", "done", 4, 3, 3, 0)], key=repr)
    assert rows(harvest.harvested(exchanges, marks.limit(0), picky, hold_newest=False)) == sorted(
        [("a", "done", 8, 9, 9, 0), ("b", "pending", -1, 3, 0, 1), ("c", "done", 1, 2, 2, 0), ("d", "done", 5, 6, 6, 0)], key=repr)
    assert harvest.harvested(exchanges.limit(0), marks, picky).count() == 0


def test_every_exchange_is_asked_for_once_in_halves(spark):
    parts = spark.createDataFrame([("a", [(i, f"t{i}") for i in range(13)])], "thread string, rows array<struct<i int, text string>>")
    got = harvest.asked(parts, picky, 16).select("outcome", F.explode("items")).collect()
    assert {r[0] for r in got} == {"done"}
    assert sorted(r[1] for r in got) == sorted(f"{i}:t{i}" for i in range(13))
    assert harvest.in_halves(picky(), [(i, "x") for i in range(10)]) == [f"{i}:x" for i in range(10)]
    with pytest.raises(harvest.TooLong):
        harvest.in_halves(lambda rows: (_ for _ in ()).throw(harvest.TooLong()), [(1, "x"), (2, "y")])
