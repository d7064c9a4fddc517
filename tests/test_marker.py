"""Markers go in and come out again; other edits are noticed."""

import hashlib

from pyspark.sql import functions as F

from passagework.functions.marker import marked, same_but_for_marker

TEXTS = ["", "plain", "---\na: 1\n---\nbody", "---\r\na: 1\r\n---\r\nbody\r\n", "---\n---\nx", "---\nnever closed", "one\r\ntwo", "---\na: superseded_by: r1\n---\n---\n", "ü\n---\n"]
WANT = {"plain": "---\nsuperseded_by: r1\n---\nplain", "---\na: 1\n---\nbody": "---\na: 1\nsuperseded_by: r1\n---\nbody", "---\n---\nx": "---\nsuperseded_by: r1\n---\nx",
        "---\r\na: 1\r\n---\r\nbody\r\n": "---\r\na: 1\r\nsuperseded_by: r1\r\n---\r\nbody\r\n"}


def test_marker_is_taken_out_again(spark):
    d = spark.createDataFrame([(t, hashlib.sha256(t.encode()).hexdigest()) for t in TEXTS] + [(None, "x")], "text string, digest string")
    m = d.withColumn("m", marked(F.col("text"), F.lit("r1")))
    ok = lambda text, record: F.coalesce(same_but_for_marker(text, F.lit(record), F.col("digest")), F.lit(False))
    got = m.select("text", "m", ok(F.col("m"), "r1").alias("same"), ok(F.col("m"), "r2").alias("other"), ok(F.concat("m", F.lit("!")), "r1").alias("edited"), ok(F.col("text"), "r1").alias("bare")).collect()
    for r in got:
        if r["text"] is None:
            assert r["m"] is None and not r["same"]
            continue
        assert not r["other"] and not r["edited"] and not r["bare"], r
        assert r["same"] or r["text"].startswith("---\na: superseded_by"), r
        assert r["m"] == WANT.get(r["text"], r["m"])
