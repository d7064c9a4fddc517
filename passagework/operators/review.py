"""Review digests and work lists: items parsed from Markdown lines, decisions, merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import decision_of, item_id


def items(lines: DataFrame) -> DataFrame:
    """(path, line, section, tag, statement, quote, decision, id) of digests given as lines (path, line, text).

    `## name` opens a section, `- [mark] **tag** statement` is an item, and an indented `> quote` below belongs to it.
    """
    order = Window.partitionBy("path").orderBy("line")
    mark = lines.withColumn("section", F.last(F.when(F.col("text").startswith("## "), F.trim(F.substring("text", F.lit(4), F.length("text")))), ignorenulls=True).over(order))
    is_item = F.col("text").rlike(r"^- \[.\] ")
    own = mark.withColumn("item_line", F.last(F.when(is_item, F.col("line")).when(F.col("text").startswith("## "), F.lit(-1)), ignorenulls=True).over(order))
    quote = F.when(F.col("text").rlike(r"^\s+> "), F.trim(F.regexp_replace("text", r"^\s+> ", "")))
    pattern = r"^- \[.\] (?:\*\*([^*]+)\*\* )?(.*)$"
    rows = own.where("item_line >= 0").groupBy("path", "item_line").agg(
        F.max(F.when(is_item, F.col("text"))).alias("text"), F.max(F.when(is_item, F.col("section"))).alias("section"), F.min_by(quote, F.when(quote.isNotNull(), F.col("line"))).alias("quote"))
    statement = F.regexp_extract("text", pattern, 2)
    return rows.select("path", F.col("item_line").alias("line"), "section", F.regexp_extract("text", pattern, 1).alias("tag"), statement.alias("statement"), F.coalesce("quote", F.lit("")).alias("quote"), decision_of(F.col("text")).alias("decision"), item_id(statement).alias("id"))


def first_seen(rows: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """One row for each statement that is equal but for case: the first in the order."""
    place = F.row_number().over(Window.partitionBy(F.lower(text)).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def without_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.select("path", "id"), ["path", "id"], "left_anti")


def merged_cards(cards: DataFrame, others: DataFrame) -> DataFrame:
    """(card rows with badges): notes and items join the card whose short code their text holds, else the only card of their number.

    cards has code, number, title, due and touched; others has origin, id and text. What names no card is a row of
    its own. Numbers that several cards share match nothing.
    """
    link = others.withColumn("code", F.nullif(F.regexp_extract("text", r"/c/([A-Za-z0-9]+)", 1), F.lit(""))).withColumn("num", F.expr("try_cast(nullif(regexp_extract(text, '#([0-9]+)', 1), '') as int)"))
    single = cards.groupBy("number").agg(F.min("code").alias("by_number"), F.count(F.lit(1)).alias("n")).where("n = 1 and number is not null")
    known = cards.select(F.col("code").alias("by_code"))
    both = link.join(known, F.col("code") == F.col("by_code"), "left").join(single.select(F.col("number").alias("num"), "by_number"), "num", "left").withColumn("card", F.coalesce("by_code", "by_number"))
    badges = both.where("card is not null").groupBy(F.col("card").alias("code")).agg(F.array_sort(F.collect_set("origin")).alias("badges"))
    on_cards = cards.join(badges, "code", "left").select("code", "title", "due", "touched", F.concat(F.array(F.lit("card")), F.coalesce("badges", F.array().cast("array<string>"))).alias("badges"))
    alone = both.where("card is null").select(F.lit(None).cast("string").alias("code"), F.col("text").alias("title"), F.lit(None).cast(dict(cards.dtypes)["due"]).alias("due"), F.lit(None).cast(dict(cards.dtypes)["touched"]).alias("touched"), F.array("origin").alias("badges"))
    return on_cards.unionByName(alone)


def classified(scores: DataFrame) -> DataFrame:
    """Items (type, supported, durable, withdrawn, owner_stated) with verdict and attribution; without scores they are new."""
    c = F.col
    verdict = F.when(c("supported").isNull(), "new").when((c("supported") < 0.3) | (c("durable") < 0.3), "drop").when(c("withdrawn") >= 0.7, "review").otherwise("new")
    by = F.when((verdict == "new") & c("supported").isNotNull() & c("type").isin("decision", "preference") & (c("owner_stated") < 0.5), "assistant").otherwise("owner")
    return scores.withColumns({"verdict": verdict, "attribution": by})


MARKS = {"accepted": "x", "rejected": "-", "open": " "}


def rendered(rows: DataFrame) -> DataFrame:
    """(path, text): items (path, section, tag, statement, quote, decision, line) as digests that items() reads back."""
    mark = F.coalesce(F.create_map(*(F.lit(x) for p in MARKS.items() for x in p))[F.col("decision")], F.lit(" "))
    tag = F.when(F.col("tag") != "", F.concat(F.lit("**"), F.col("tag"), F.lit("** "))).otherwise("")
    quote = F.when(F.col("quote") != "", F.concat(F.lit("\n  > "), F.col("quote"))).otherwise("")
    line = F.concat(F.lit("- ["), mark, F.lit("] "), tag, F.col("statement"), quote)
    first = F.min("line").over(Window.partitionBy("path", "section"))
    parts = rows.select("path", "section", "line", line.alias("t"), first.alias("first"))
    bodies = parts.groupBy("path", "section").agg(F.min("first").alias("first"), F.array_join(F.array_sort(F.collect_list(F.struct("line", "t")))["t"], "\n").alias("body"))
    block = F.concat(F.lit("## "), F.coalesce("section", F.lit("")), F.lit("\n"), F.col("body"))
    return bodies.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", block.alias("b"))))["b"], "\n").alias("text"))


def decide(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """items after decisions (path, id, decision, at): the latest decision of an id holds, for its first undecided item.

    Of items with one id in a digest the undecided one comes first, then the one of the least line.
    """
    last = decisions.groupBy("path", "id").agg(F.max_by("decision", "at").alias("_new"))
    place = Window.partitionBy("path", "id").orderBy(F.col("decision") != "open", "line")
    both = rows.withColumn("_place", F.row_number().over(place)).join(last, ["path", "id"], "left")
    return both.withColumn("decision", F.when((F.col("_place") == 1) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("decision"))).drop("_place", "_new")


def undoable(history: DataFrame, now: Column, most: int = 20, days: int = 2) -> DataFrame:
    """The saved versions (path, version, saved_at, digest) that may still be undone: the newest few of recent days."""
    place = Window.partitionBy("path").orderBy(F.desc("version"))
    fresh = history.where(F.col("saved_at") >= now - F.expr(f"interval {days} days"))
    return fresh.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)


def undone(history: DataFrame, live: DataFrame) -> DataFrame:
    """(path, version): the version to restore, where the live digest is still what the newest decision wrote."""
    newest = history.groupBy("path").agg(F.max("version").alias("version"), F.max_by("digest", "version").alias("digest"))
    same = newest.join(live.select("path", "digest"), ["path", "digest"], "left_semi")
    return same.join(history.select("path", F.col("version").alias("v")), "path").where("v < version").groupBy("path").agg(F.max("v").alias("version"))


def rechecked(rows: DataFrame, scores: DataFrame, real: float = 0.75) -> DataFrame:
    """items with the section that new conflict scores (id, conflict, known) put them in; unscored ones stay."""
    both = rows.join(scores.groupBy("id").agg(F.max("conflict").alias("conflict"), F.max("known").alias("known")), "id", "left")
    section = F.when(F.col("conflict") >= real, "conflicts").when(F.col("known") >= 0.7, "known").when(F.col("conflict").isNotNull(), "new").otherwise(F.col("section"))
    return both.withColumn("section", section).drop("conflict", "known")
