import numpy as np
from pyspark.sql import functions as F

from passagework.operators import layout, review
from passagework.plans.recall import formatted

ITEMS = "path string, line int, section string, tag string, statement string, quote string, decision string"


def test_digest_round_trip(spark, rows):
    d = spark.createDataFrame([("p", 1, "new", "fact", "water is wet", "so wet", "open"), ("p", 2, "new", "", "again", "", "accepted"), ("p", 9, "known", "fact", "old", "q", "rejected")], ITEMS)
    lines = review.rendered(d).select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    assert rows(review.items(lines).select("section", "tag", "statement", "quote", "decision")) == rows(d.select("section", "tag", "statement", "quote", "decision"))


def test_decide_and_recheck(spark, rows):
    d = spark.createDataFrame([("p", 1, "new", "", "a", "", "accepted"), ("p", 2, "new", "", "a", "", "open"), ("p", 3, "new", "", "b", "", "open")], ITEMS).withColumn("id", F.col("statement"))
    got = review.decide(d, spark.createDataFrame([("p", "a", "accepted", 1), ("p", "a", "rejected", 2)], "path string, id string, decision string, at int"))
    assert rows(got.select("line", "decision")) == [(1, "accepted"), (2, "rejected"), (3, "open")]
    moved = review.rechecked(d, spark.createDataFrame([("a", 0.8, 0.0), ("b", 0.1, 0.9)], "id string, conflict double, known double"))
    assert rows(moved.select("line", "section")) == [(1, "conflicts"), (2, "conflicts"), (3, "known")]


def test_undo(spark, rows):
    h = spark.createDataFrame([("p", 1, "x", "2026-01-01"), ("p", 2, "y", "2026-01-02"), ("q", 1, "a", "2025-01-01"), ("q", 2, "b", "2025-01-02")], "path string, version int, digest string, day string").withColumn("saved_at", F.to_timestamp("day"))
    live = spark.createDataFrame([("p", "y"), ("q", "other")], "path string, digest string")
    assert rows(review.undone(h, live)) == [("p", 1)]
    assert {r["path"] for r in review.undoable(h, F.to_timestamp(F.lit("2026-01-02"))).collect()} == {"p"}


def test_layout_stays_in_discs(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in [(1, 2), (2, 3), (1, 3), (10, 11), (11, 12), (3, 10)]], "a long, b long, weight double")
    c = spark.createDataFrame([(n, 0 if n < 5 else 1) for n in (1, 2, 3, 10, 11, 12)], "node long, cluster long")
    got = layout.placed(e, c).collect()
    where = layout.discs([(0, 3), (1, 3)])
    assert len(got) == 6
    for r in got:
        x, y, radius = where[r["cluster"]]
        assert np.hypot(r["x"] - x, r["y"] - y) <= radius
    (a, b, r), (c2, d, s) = where.values()
    assert np.hypot(a - c2, b - d) >= r + s
    assert sorted(map(tuple, layout.placed(e, c).collect())) == sorted(map(tuple, got))


def test_formatted_heads_once(spark):
    d = spark.createDataFrame([("q", 1, "A", "one", False), ("q", 2, "B", "two", False), ("q", 3, "A", "three", True)], "qid string, place int, citation string, shown string, truncated boolean")
    assert formatted(d).first()["text"] == "# A\none\n\n# B\ntwo\n\nthree …"
