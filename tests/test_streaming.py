import datetime as dt

from passagework.streaming import events


def stream(spark, tmp_path, rows, schema, name, make, mode):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


AT = dt.datetime(2026, 1, 1)
SCHEMA = "id string, body string, at timestamp"


def test_once(spark, tmp_path):
    got = stream(spark, tmp_path, [("a", "1", AT), ("a", "1", AT), ("b", "2", AT)], SCHEMA, "once", lambda s: events.once(s, "id", "at", "1 hour"), "append")
    assert sorted(r["id"] for r in got) == ["a", "b"]


def test_conflicts(spark, tmp_path):
    rows = [("a", "1", AT), ("a", "1", AT + dt.timedelta(seconds=1)), ("a", "2", AT + dt.timedelta(seconds=2))]
    got = stream(spark, tmp_path, rows, SCHEMA, "verdicts", lambda s: events.with_verdicts(s, "id", "body", "at", "1 hour"), "update")
    assert {(r["verdict"], r["n"]) for r in got} == {("accepted", 1), ("replay", 1), ("conflict", 1)}


def test_idle(spark, tmp_path):
    rows = [("a", "", AT), ("a", "", AT + dt.timedelta(minutes=10)), ("a", "", AT + dt.timedelta(hours=3))]
    got = stream(spark, tmp_path, rows, SCHEMA, "idle", lambda s: events.idle_sessions(s, "id", "at"), "append")
    assert [(r["n"]) for r in got] == [2]


def test_marks(spark, rows):
    turns = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "g int, i int")
    marks = spark.createDataFrame([(1, 0)], "g int, done int")
    new = events.beyond_marks(turns, marks, "g", "i")
    assert rows(new) == [(1, 1)]
    assert rows(events.advanced(marks, new, "g", "i")) == [(1, 1)]
