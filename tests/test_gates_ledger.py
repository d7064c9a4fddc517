import pytest
from pyspark.sql import functions as F

from passagework.operators import gates, ledger, sync


def test_rerank_cuts_reorders_and_fails_openly(spark, rows):
    d = spark.createDataFrame([(1, "q", "a", "aaaa", 1), (1, "q", "b", "aa", 2), (1, "q", "c", "", 3), (2, "q", "d", None, 1)], "g int, q string, k string, t string, rank int")
    got = gates.reranked(gates.scored(d, "q", "t", lambda: lambda q, t: [len(x) for x in t]), "g", ["k"], 1)
    assert [(r["k"], r["rank"]) for r in got.orderBy("g", "rank").collect()] == [("a", 1), ("b", 2)]

    def broken():
        return lambda q, t: 1 / 0

    got = gates.reranked(gates.scored(d, "q", "t", broken), "g", ["k"], 1)
    assert [(r["k"], r["rank"]) for r in got.orderBy("g", "rank").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 1)]


def test_judge(spark, rows):
    d = spark.createDataFrame([("ok", 0.9, 0.5, 0.1, False), ("weak", 0.2, 0.5, 0.1, False), ("bad", 0.9, 0.5, 0.9, False), ("odd", 1.5, 0.5, 0.1, False), ("held", 0.0, 0.0, 1.0, True), ("none", None, 0.5, 0.1, None)], "k string, relevance double, best double, injection double, secret boolean")
    assert rows(gates.judged(d).select("k", "judged")) == [("held", False), ("none", False), ("odd", False), ("ok", True)]
    r = spark.createDataFrame([(1, "a", 1, True, 0.2, 0.9), (1, "b", 2, True, 0.7, 0.6), (1, "c", 3, True, 0.7, 0.8), (1, "d", 0, False, 0.9, 0.9)], "q int, k string, rank int, judged boolean, best double, relevance double")
    assert [x["k"] for x in gates.judged_order(r, "q", ["k"]).orderBy("rank").collect()] == ["c", "b", "a", "d"]
    ok = lambda *v: spark.createDataFrame([v], "c array<double>, r array<double>, i array<double>, n int").select(gates.contract_kept(*(F.col(x) for x in "crin"))).first()[0]
    assert ok([0.5, 0.5], [1.0, 0.0], [0.0, 0.1], 2) and not ok([0.5, 0.2], [1.0, 0.0], [0.0, 0.1], 2) and not ok([1.0], [1.0], [0.0], 2) and not ok([0.5, 0.5], [1.2, 0.0], [0.0, 0.1], 2) and not ok(None, [1.0], [0.0], 1)


def test_providers(spark, rows):
    gates.register("size", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    d = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
    assert [(r["k"], list(r["vector"])) for r in gates.embedded(d, "k", "t", gates.provider("size")).orderBy("k").collect()] == [(1, [3.0, 1.0]), (2, [0.0, 1.0])]
    with pytest.raises(ValueError):
        gates.provider("missing")


def test_extraction_tries_twice(spark, rows):
    d = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad")], "g int, p int, t string")

    def factory():
        calls = []

        def ask(text):
            calls.append(text)
            if text == "bad" or len(calls) == 1:
                raise ValueError
            return [{"type": "fact", "statement": text, "quote": text, "exchange": 1}, "noise"]

        return ask

    assert rows(gates.extracted(d.coalesce(1), "g", "p", "t", factory).select("p", "statement")) == [(0, "good")]
    items = spark.createDataFrame([(1, "fact", "A"), (2, "fact", "a "), (3, "rumour", "b"), (4, "decision", "c")], "item_id int, type string, statement string")
    places = spark.createDataFrame([(1, 1, "owner"), (2, 1, "owner"), (3, 1, "owner")], "item_id int, i int, speaker string")
    assert rows(gates.verified_items(items, places).select("item_id")) == [(1,)]


def test_ledger(spark, rows):
    old = spark.createDataFrame([(1, "a")], "event_id int, body string")
    assert rows(ledger.appended(old, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "event_id int, body string"))) == [(1, "a"), (2, "c")]
    records = spark.createDataFrame([(i, 1, "draft" if i < 5 else "accepted") for i in range(1, 6)], "record_id int, revision int, state string")
    asked = spark.createDataFrame([(1, 1, "accepted"), (1, 1, "accepted"), (2, 0, "accepted"), (3, 1, "accepted"), (3, 1, "rejected"), (5, 1, "rejected")], "record_id int, expected_revision int, state string")
    got = {r["record_id"]: (r["state"], r["revision"], r["outcome"]) for r in ledger.decided(records, asked).collect()}
    assert got == {1: ("accepted", 2, "done"), 2: ("draft", 1, "stale"), 3: ("draft", 1, "conflict"), 4: ("draft", 1, "none"), 5: ("accepted", 1, "settled")}


def test_supersede_and_diff(spark, rows):
    r = spark.createDataFrame([(1, 1, "x", "accepted", True), (2, 1, "y", "accepted", True)], "record_id int, revision int, content string, state string, current boolean")
    got = ledger.superseded(r, spark.createDataFrame([(1, "x2")], "record_id int, content string"))
    assert rows(got.select("record_id", "revision", "state", "current")) == [(1, 1, "superseded", False), (1, 2, "accepted", True), (2, 1, "accepted", True)]
    assert rows(ledger.current(got).select("record_id", "content")) == [(1, "x2"), (2, "y")]
    d = ledger.diffs(spark.createDataFrame([(1, "a\nb", "a\nc")], "k int, o string, n string"), "k", "o", "n").first()["diff"]
    assert "-b" in d and "+c" in d


def test_pack(spark, tmp_path, rows):
    v = spark.createDataFrame([("k", [1.0, 2.0]), ("k", [1.0, 2.0]), ("m", [0.0, 1.0])], "key string, vector array<double>")
    sync.write_pack(v, str(tmp_path / "p"), "f1")
    assert sync.load_pack(spark, str(tmp_path / "p"), "f1").count() == 2 and sync.load_pack(spark, str(tmp_path / "p"), "f2").count() == 0
    assert sync.one_dimension(v) and not sync.one_dimension(v.unionByName(spark.createDataFrame([("z", [1.0])], v.schema)))
