"""Notes as text: recaps, raw transcripts, meeting digests and day logs, rendered in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import front as fm
from passagework.operators.meetings import exchange_text

#: Headings of a recap's groups, in their order.
GROUPS = {"new": "New", "conflict": "Conflicts with what is recorded", "review": "To check", "resolved": "Settled", "dropped": "Dropped", "known": "Already recorded"}
LABELS = {"decision": "Decision", "fact": "Fact", "preference": "Preference", "open_item": "Open item", "summary": "Summary"}


def _json(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _label(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v) for k, v in LABELS.items()), kind)


def sections(exchanges: DataFrame, thread: str) -> DataFrame:
    """(thread, i, text): exchanges as sections of a raw transcript."""
    text = F.concat(F.lit("## Exchange "), F.col("i").cast("string"), F.lit("\n\n**Owner:** "), F.coalesce("user", F.lit("")), F.lit("\n\n**Assistant:** "), F.coalesce("assistant", F.lit("")))
    return exchanges.select(thread, "i", text.alias("text"))


def raw_transcripts(exchanges: DataFrame, held: DataFrame, thread: str) -> DataFrame:
    """(thread, fresh, text): what each raw transcript gains, the exchanges after the last one that it holds; fresh for those that are new files.

    held has thread and last. A thread with nothing to gain gives no row. Sections are joined a thread at a time, as one file is.
    """
    new = sections(exchanges, thread).join(held.select(thread, "last"), thread, "left").where(F.col("last").isNull() | (F.col("i") > F.col("last")))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("i", "text")))["text"], "\n\n")
    return new.groupBy(thread).agg(F.max(F.col("last").isNull()).alias("fresh"), body.alias("text"))


def held_exchanges(raw: DataFrame, thread: str, text: str) -> DataFrame:
    """(thread, last): the number of the last exchange that each raw transcript holds, by its headings."""
    found = F.array_max(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^## Exchange (\d+)$"), F.lit(1)), lambda n: n.cast("long")))
    return raw.groupBy(thread).agg(F.coalesce(F.max(found), F.lit(0)).alias("last"))


def item_line(item: DataFrame) -> Column:
    """An item as a recap shows it: its kind, statement and match, the quote with its place, the passage that contradicts it, and why."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    opt = lambda c, before, after="": F.when(has(c), F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")
    return F.concat(
        F.lit("- **"), _label(F.col("type")), F.when(F.col("attribution") == "assistant", " · assistant").otherwise(""), F.lit(":** "), F.col("statement"), opt("match", " ↔ [[", "]]"),
        F.lit("\n  > "), F.col("quote"), F.lit(" *(exchange "), F.col("exchange").cast("string"), F.lit(", "), F.col("speaker"), opt("at", ", "), F.lit(")*"), opt("match_text", "\n  ≠ "), opt("why", "\n  ∵ "),
    )


def recaps(items: DataFrame, by: str, title: Column, day: Column) -> DataFrame:
    """(by, text): a recap a thread of items (by, item_id, grp, type, statement, quote, exchange, speaker, at, match, match_text, why, attribution).

    Groups stand in a fixed order, items in theirs; a recap is a draft until its items are decided.
    """
    place = F.coalesce(*(F.when(F.col("grp") == g, i) for i, g in enumerate(GROUPS)))
    short = F.concat(F.lit("- "), F.col("statement"), F.lit(" → [["), F.coalesce("match", F.lit("")), F.lit("]]"))
    line = F.when(F.col("grp").isin("resolved", "dropped", "known"), short).otherwise(item_line(items))
    rows = items.select("*", place.alias("_place"), line.alias("_line"), title.alias("_title"), day.alias("_day"))
    grouped = rows.groupBy(by, "_place").agg(F.array_join(F.array_sort(F.collect_list(F.struct("item_id", "_line")))["_line"], "\n").alias("_text"), F.count(F.lit(1)).alias("_n"), F.min("_title").alias("_title"), F.min("_day").alias("_day"))
    head = F.element_at(F.array(*(F.lit(v) for v in GROUPS.values())), F.col("_place") + 1)
    parts = grouped.select(by, "_place", "_n", "_title", "_day", F.concat(F.lit("## "), head, F.lit("\n\n"), F.col("_text"), F.lit("\n")).alias("_text"))
    count = lambda g: F.coalesce(F.max(F.when(F.col("_place") == list(GROUPS).index(g), F.col("_n"))), F.lit(0)).cast("string")
    whole = parts.groupBy(by).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_place", "_text")))["_text"], "\n").alias("_body"), F.min("_title").alias("_title"), F.min("_day").alias("_day"),
        F.concat(count("new"), F.lit(" new, "), count("conflict"), F.lit(" conflict, "), count("known"), F.lit(" already recorded")).alias("_counts"),
    )
    block = fm.yaml_block({"type": (F.lit("output"), "string"), "title": (F.col("_title"), "string"), "description": (F.concat("_title", F.lit(": "), "_counts"), "string"), "created": (F.col("_day"), "string"), "status": (F.lit("draft"), "string")})
    return whole.select(by, F.concat(block, F.lit("\n\n# "), F.col("_title"), F.lit("\n\n"), F.col("_body")).alias("text"))


def unique_paths(notes: DataFrame, folder: str, title: Column, taken: DataFrame) -> DataFrame:
    """notes with a path of their own below a folder: a number is added where the name is taken, by paths in `taken` or by earlier notes (by id)."""
    named = notes.withColumn("_stem", fm.safe_title(title))
    used = taken.where(F.startswith("path", F.lit(folder + "/"))).select(F.regexp_replace(F.regexp_replace(F.substring("path", len(folder) + 2, 100_000), r"\.md$", ""), r" \(\d+\)$", "").alias("_stem")).groupBy("_stem").agg(F.count(F.lit(1)).alias("_used"))
    n = F.row_number().over(Window.partitionBy("_stem").orderBy("id")) + F.coalesce("_used", F.lit(0))
    numbered = named.join(used, "_stem", "left").withColumn("_n", n)
    return numbered.withColumn("path", F.concat(F.lit(folder + "/"), F.col("_stem"), F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".md"))).drop("_stem", "_n", "_used")


def log_day(said: Column, created: Column, today: Column) -> Column:
    """The day whose log gets an item: the day it was said, else the recap's, else today."""
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(created, F.lit("")), today)


def log_line(kind: Column, statement: Column, said: Column, unsure: Column) -> Column:
    """An item as a day's log shows it."""
    return F.concat(F.lit("- **"), _label(kind), F.when(F.coalesce(unsure, F.lit(False)), " · not sure").otherwise(""), F.lit(":** "), statement, F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.lit(" *("), said, F.lit(")*"))).otherwise(""))


def logs(entries: DataFrame, held: DataFrame, heading: str) -> DataFrame:
    """(day, text): each day's log after its entries (day, id, line) are added under the last heading; a day without a log gets one.

    held has day and text. The heading is repeated only where another one stands last.
    """
    added = entries.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", "line")))["line"], "\n\n").alias("_added"))
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(r"(?m)^## .*$"), F.lit(0))), -1)
    old = F.regexp_replace("text", r"\n+\z", "")
    grown = F.concat(old, F.when(last == f"## {heading}", "").otherwise(f"\n\n## {heading}\n"), F.lit("\n"), F.col("_added"), F.lit("\n"))
    block = fm.yaml_block({"type": (F.lit("daily"), "string"), "created": (F.col("day"), "string")})
    fresh = F.concat(block, F.lit("\n\n# "), F.col("day"), F.lit(f"\n\n## {heading}\n\n"), F.col("_added"), F.lit("\n"))
    return added.join(held, "day", "left").select("day", F.when(F.col("text").isNull(), fresh).otherwise(grown).alias("text"))


def rendered_exchanges(exchanges: DataFrame, thread: str, part: str) -> DataFrame:
    """(thread, part, text): each part's exchanges as an extractor gets them."""
    line = exchange_text(F.col("i"), F.col("user"), F.col("assistant"))
    return exchanges.groupBy(thread, part).agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", line.alias("t"))))["t"], "\n\n").alias("text"))


def pending_recaps(notes: DataFrame) -> DataFrame:
    """Recaps of notes (path, front) that wait for their review."""
    return notes.where(fm.is_pending(F.col("front")))
