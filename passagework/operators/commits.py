"""When files changed: commit dates from a history's log and from snapshots, and the time that a file shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clone_dates(logs: DataFrame, source: str = "source_id", text: str = "log") -> DataFrame:
    """(source, path, committed) of logs in git's NUL-separated form with a \\x01 before each commit's time, newest commit first: a path's first one holds."""
    # what follows a mark, up to the next one, is a commit: its time, then its files
    commits = F.transform(F.filter(F.split(text, "\x01"), lambda c: c != ""), lambda c: F.split(c, "\0"))
    rows = logs.select(source, F.posexplode(commits).alias("seq", "parts"))
    files = rows.select(source, "seq", F.trim(F.col("parts")[0]).alias("committed"), F.explode(F.slice("parts", 2, 1_000_000_000)).alias("path"))
    named = files.withColumn("path", F.regexp_replace("path", r"^\n", "")).where((F.col("path") != "") & (F.col("committed") != ""))
    return named.groupBy(source, "path").agg(F.min_by("committed", "seq").alias("committed"))


def snapshot_dates(sidecars: DataFrame, source: str = "source_id", text: str = "json") -> DataFrame:
    """(source, path, committed) of the maps that lie beside snapshots: {"files": {path: time}}; what isn't such a map gives nothing."""
    files = F.from_json(F.get_json_object(text, "$.files"), "map<string,string>")
    return sidecars.select(source, F.explode(files).alias("path", "committed")).where(F.coalesce("committed", F.lit("")) != "")


def changed_files(status: DataFrame, source: str = "source_id", text: str = "status") -> DataFrame:
    """(source, path) of files with local edits, from git's porcelain status: two letters, a blank, and the path; of a rename the new path."""
    line = status.select(source, F.explode(F.split(text, "\n")).alias("line")).where(F.length("line") > 3)
    path = F.regexp_replace(F.element_at(F.split(F.substring("line", 4, 100_000), " -> "), -1), r'^"|"$', "")
    return line.select(source, path.alias("path")).distinct()


def recorded(files: DataFrame, previous: DataFrame, asked: DataFrame) -> DataFrame:
    """(source_id, path, committed, reused) for a new snapshot's files (source_id, path, digest): files of equal bytes keep the date of the previous snapshot.

    previous has source_id, path, digest and committed; asked has the dates (source_id, path, committed) of all others.
    """
    old = previous.select("source_id", "path", F.col("digest").alias("_digest"), F.col("committed").alias("_old"))
    same = F.coalesce((F.col("digest") == F.col("_digest")) & F.col("_old").isNotNull(), F.lit(False))
    met = files.join(old, ["source_id", "path"], "left").withColumn("reused", same).join(asked, ["source_id", "path"], "left")
    return met.select("source_id", "path", F.when(F.col("reused"), F.col("_old")).otherwise(F.col("committed")).alias("committed"), "reused").where("committed is not null")


def modified(files: DataFrame, dates: DataFrame, changed: DataFrame) -> DataFrame:
    """files (source_id, path, mtime) with committed and modified: the commit's time, unless the file has none or was edited since."""
    local = changed.select("source_id", "path", F.lit(True).alias("_local"))
    met = files.join(dates.select("source_id", "path", "committed"), ["source_id", "path"], "left").join(local, ["source_id", "path"], "left")
    when: Column = F.to_timestamp("committed")
    return met.withColumn("modified", F.when(F.col("committed").isNotNull() & F.col("_local").isNull(), when).otherwise(F.col("mtime"))).drop("_local")
