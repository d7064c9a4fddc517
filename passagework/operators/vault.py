"""Listings of a collection of notes: states, overviews, names and what waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import front as fm
from passagework.functions.text import person
from passagework.operators import ranking


def index_states(live: DataFrame, indexed: DataFrame, patterns: list[str], column: str = "index_state") -> DataFrame:
    """live (source_id, path, digest) with excluded, pending (new, or changed since the index was built) or indexed."""
    old = indexed.select("source_id", "path", F.col("digest").alias("_indexed"))
    state = F.when(fm.excluded(F.col("path"), patterns), "excluded").when(F.coalesce(F.col("_indexed") == F.col("digest"), F.lit(False)), "indexed").otherwise("pending")
    return live.join(old, ["source_id", "path"], "left").withColumn(column, state).drop("_indexed")


def browsed(notes: DataFrame, now: Column) -> DataFrame:
    """(source_id, path, name, title, folder, modified, type, summary, status, lifecycle, trust, stale, draft, locked, system, approvable, review, digest) of notes (source_id, path, front, heading, modified)."""
    front, path = F.col("front"), F.col("path")
    view, system = fm.view(front, now), fm.is_system(path)
    text = lambda name: F.when(~F.coalesce(fm.field(front, name), F.lit("")).rlike(r"^[\[{]"), fm.field(front, name))
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return notes.select(
        "source_id", "path", name.alias("name"), F.coalesce(F.nullif(text("title"), F.lit("")), F.nullif("heading", F.lit("")), name).alias("title"), folder(path).alias("folder"), "modified",
        F.coalesce(text("type"), F.lit("")).alias("type"), view["description"].alias("summary"), F.coalesce(text("status"), F.lit("")).alias("status"), view["status"].alias("lifecycle"), view["trust"].alias("trust"),
        view["stale"].alias("stale"), (view["status"] == "draft").alias("draft"), F.coalesce(fm.field(front, "lock") == "true", F.lit(False)).alias("locked"), system.alias("system"),
        (~system & fm.not_approvable(front).isNull()).alias("approvable"), (~system & fm.awaits_review(path, front)).alias("review"), fm.is_recap(front).alias("digest"),
    )


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def top_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def overview(listing: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row a source: notes, system files, drafts, what awaits review, the inbox, and what changed in the trailing days."""
    own = ~F.col("system")
    return listing.groupBy("source_id").agg(
        F.count_if(own).alias("total"), F.count_if(F.col("system")).alias("system_files"), F.count_if(own & F.col("draft")).alias("drafts"), F.count_if(own & F.col("review")).alias("awaiting_review"),
        F.count_if(own & F.startswith("path", F.lit(fm.INBOX + "/"))).alias("inbox"), F.count_if(own & (F.col("modified") >= now - F.expr(f"INTERVAL {days} DAYS"))).alias("changed_lately"),
    )


def folders(listing: DataFrame) -> DataFrame:
    """(source_id, folder, n, place): notes of each top folder, most first."""
    n = listing.where("not system").groupBy("source_id", top_folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.numbered(n, ["source_id"], [F.desc("n"), F.asc("folder")], "place")


def recent(listing: DataFrame, n: int = 12) -> DataFrame:
    """The notes of each source that changed last; generated indexes don't count."""
    own = listing.where(~F.col("system") & ~F.endswith("path", F.lit("_index.md")))
    return ranking.top(own, ["source_id"], [F.desc("modified"), F.asc("path")], n, "place")


def approvals(notes: DataFrame) -> DataFrame:
    """(source_id, path, outcome) of notes (source_id, path, front) that a bulk approval takes: approved, or the reason why it is skipped."""
    return notes.select("source_id", "path", F.coalesce(fm.not_approvable(F.col("front")), F.lit("approved")).alias("outcome"))


def conformance(notes: DataFrame) -> DataFrame:
    """One row of counts over notes (path, front): how many have what the format asks for, and what is left of older spellings."""
    front = F.col("front")
    has = lambda name: F.coalesce(fm.field(front, name), F.lit("")) != ""
    concept = ~fm.is_reserved(F.col("path"), front)
    return notes.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~concept).alias("reserved"), F.count_if(concept & ~has("type")).alias("without_type"), F.count_if(concept & (fm.view(front, F.current_timestamp())["description"] == "")).alias("without_description"),
        F.count_if(concept & ~fm.lifecycle(front)["known"]).alias("unknown_status"), F.count_if(concept & fm.is_draft(front)).alias("drafts"), F.count_if(concept & has("draft")).alias("legacy_draft"),
        F.count_if(concept & (F.size(fm.source_entries(front)) > 0)).alias("with_sources"), F.count_if(concept & (F.size(fm.verified(front)) > 0)).alias("verified"),
    )


def names(said: DataFrame, name: str = "name") -> DataFrame:
    """(key, name, uses): each name by its most used spelling, ties to one with capitals; a first name alone joins the only full name that it begins.

    Spellings are one name if they are equal once folded.
    """
    spelled = said.where(F.trim(name) != "").groupBy(person(F.col(name)).alias("key"), F.trim(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    own = spelled.groupBy("key").agg(F.sum("n").alias("uses"))
    best = ranking.top(spelled, ["key"], [F.desc("n"), F.desc(F.col("name") != F.lower("name")), F.asc("name")], 1).select("key", "name")
    known = best.join(own, "key")
    full = known.where(F.contains("key", F.lit(" "))).select(F.substring_index("key", " ", 1).alias("first"), F.col("key").alias("full_key"))
    only = full.groupBy("first").agg(F.count(F.lit(1)).alias("k"), F.min("full_key").alias("full_key")).where("k = 1")
    joined = known.join(only, F.col("key") == F.col("first"), "left").select(F.coalesce("full_key", "key").alias("key"), "uses")
    return joined.groupBy("key").agg(F.sum("uses").alias("uses")).join(best, "key").select("key", "name", "uses")


def review_counts(records: DataFrame) -> DataFrame:
    """(source_id, pending, rejected, conflicts) of records (source_id, state, conflict)."""
    return records.groupBy("source_id").agg(F.count_if(F.col("state") == "draft").alias("pending"), F.count_if(F.col("state") == "rejected").alias("rejected"), F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts"))


def status(records: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(source_id, files, indexed, pending, state) of records (source_id, index_state) of the visible sources."""
    rows = records if sources is None else records.where(F.col("source_id").isin(*sources) if sources else F.lit(False))
    n = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("index_state") == "indexed").alias("indexed"), F.count_if(F.col("index_state") == "pending").alias("pending"))
    return n.withColumn("state", F.when(F.col("pending") == 0, "fresh").otherwise("stale"))


def first_lines(passages: DataFrame) -> DataFrame:
    """(source_id, path, line) of passages (source_id, path, chunk_id, title, heading, text): the summary, else the title of the first passage."""
    best = ranking.top(passages, ["source_id", "path"], [F.desc(F.col("heading") == "summary"), F.asc("chunk_id")], 1)
    return best.select("source_id", "path", F.when(F.col("heading") == "summary", F.col("text")).otherwise(F.col("title")).alias("line"))


def catalog(passages: DataFrame, in_folder: str = "", most: int = 120_000) -> DataFrame:
    """(source_id, path, summary, running): one line a file in the order of source and path, until the running size of paths and lines passes `most`.

    The files are numbered by ranges of the order, so no task numbers them all.
    """
    rows = first_lines(passages)
    if in_folder.strip("/"):
        rows = rows.where((F.col("path") == in_folder.strip("/")) | F.startswith("path", F.lit(in_folder.strip("/") + "/")))
    line = rows.select("source_id", "path", F.substring(F.trim(F.regexp_replace("line", r"\s+", " ")), 1, 300).alias("summary"))
    return ranking.within_running_total(line, ["source_id", "path"], F.length("path") + F.length("summary") + 8, most)
