"""Places of all rows by ranges: no limit, hot groups, ties, nulls; listings of more than ten thousand notes."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from passagework.functions.timeframe import parse
from passagework.operators import ranking, review, work
from passagework.plans import recall


@pytest.mark.parametrize("by", [[], ["g"]])
def test_places_go_on_over_ranges(spark, by):
    made = [(None if i % 10 == 9 else "hot" if i % 10 < 7 else f"g{i % 3}", i // 5 if i % 11 else None, i) for i in range(3000)]
    d = spark.createDataFrame(made, "g string, v int, k int").repartition(6)
    got = ranking.numbered(d, by, [F.desc_nulls_last("v"), F.asc("k")], "place").collect()
    groups = defaultdict(list)
    for g, v, k in made:
        groups[g if by else None].append((-1 if v is not None else 0, -(v or 0), k))
    want = {k: i + 1 for rows in groups.values() for i, (_, _, k) in enumerate(sorted(rows))}
    assert {r["k"]: r["place"] for r in got} == want and len(got) == 3000


def test_empty_table_and_names_that_look_like_ours(spark):
    d = spark.createDataFrame([(1, 5), (2, 4)], "k int, `a.b` int")
    assert sorted((r["k"], r["rank"]) for r in ranking.numbered(d, [], [F.asc("`a.b`")]).collect()) == [(1, 2), (2, 1)]
    assert ranking.numbered(d.where("k > 5"), [], [F.asc("k")]).count() == 0


def test_listing_has_no_limit(spark):
    import datetime as dt

    frame = parse("what did we do last week", dt.date(2025, 2, 12))
    n = spark.range(10_050).select(F.lit("s").alias("source_id"), F.format_string("n%05d.md", "id").alias("path"))
    rows = n.select(F.concat_ws("#", "path", F.lit("1")).alias("chunk_id"), "source_id", "path", F.lit("T").alias("title"), F.lit("body").alias("heading"), F.lit("x").alias("text"), F.lit("note").alias("kind"), F.lit(frame.start).cast("date").alias("day"))
    got = recall.listing(rows)
    assert got.agg(F.count(F.lit(1)), F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (10_050, 1, 10_050, 10_050)
    assert got.where("rank = 1").first()["path"] == "n10049.md"


def test_recaps_are_numbered_newest_first(spark):
    paths = spark.createDataFrame([(f"+/2025-02-{d:02d} — session {k}.md",) for d in (1, 5, 9) for k in "ab"] + [("+/2024-01-01 — session old.md",), ("+/notes.md",), (None,)], "path string")
    got = sorted((r["place"], r["path"]) for r in work.recaps_of_window(paths, "2025-02-12").collect())
    assert [p for _, p in got] == [f"+/2025-02-{d:02d} — session {k}.md" for d in (9, 5, 1) for k in "ba"] and [i for i, _ in got] == list(range(1, 7))


def test_long_section_names_stay_whole(spark):
    name = "n" * 3000
    lines = spark.createDataFrame([("p", 1, "## " + name), ("p", 2, "- [ ] **fact** said")], "path string, line int, text string")
    assert review.items(lines).first()["section"] == name
