"""Scans that read listings and file heads, and of a folder only what has changed since the last one; probes that read footers only."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import versions
from passagework.sources.intake import opened
from passagework.sources.notes import _HIDDEN, MOST_BYTES, front_matter

#: What a scan keeps of a file; front is JSON text.
SCANNED = "path string, size bigint, modified timestamp, front string"
#: Bytes of a file's head that are read at first; longer front matter is read on.
HEAD = 4096


def listing(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path below root, size, modified) of every file that a scan takes, from the store's listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").removeprefix("file:") + "/"
    rows = files.where(F.col("length") <= MOST_BYTES).select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(~F.concat(F.lit("/"), F.col("path")).rlike(_HIDDEN))


def head(root: str, path: str) -> str:
    """The beginning of a file, up to the end of its front matter; a file without any is read no further than HEAD bytes."""
    store, base = opened(root)
    with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
        data = f.read(HEAD)
        while data.startswith(b"---") and b"\n---" not in data[3:].replace(b"\r", b"") and (more := f.read(len(data))):
            data += more
        end = data.find(b"\n---", 3)
        rest = data[end + 4 :] if end >= 0 else b""
        if end >= 0 and b"\n" not in rest:  # the closing line may go on
            data += f.read(HEAD)
    return data.decode("utf-8", "replace")


def fronts(root: str, files: DataFrame) -> DataFrame:
    """files (path, size, modified) with the front matter of each as JSON text; only these are opened, where their rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(front=[json.dumps(front_matter(head(root, p))[0], ensure_ascii=False, default=str) for p in b["path"]])

    return files.select("path", "size", "modified").mapInPandas(run, SCANNED)


def scan(spark: SparkSession, root: str, cache: str, pattern: str = "*.md") -> tuple[DataFrame, int]:
    """(SCANNED rows of every file below root, how many files were opened).

    cache is a versioned table of the last scan. A file whose path, size and modification time it holds isn't opened; a
    scan that finds nothing changed writes nothing. Of two scans at once one starts again, as versions.update does.
    """
    for _ in range(5):
        base = versions.latest(spark, cache)
        known, now = versions.snapshot(spark, cache, "path", SCANNED, base), listing(spark, root, pattern)
        changed = now.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")
        gone = known.select("path").join(now.select("path"), "path", "left_anti")
        n = changed.count()
        if not n and gone.isEmpty():
            return known, 0
        try:
            parts = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
            return versions.snapshot(spark, cache, "path", SCANNED, versions.commit(spark, cache, fronts(root, changed.repartition(parts, "path")), "path", base, gone=gone)), n
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{cache} is written by others all the time")


def usable(spark: SparkSession, folder: str, schema: str) -> tuple[bool, str]:
    """(whether a Parquet table in folder can serve as an index of this schema, why not).

    Footers alone are read: an empty table of the schema is usable, a full one without a column or with another type isn't.
    """
    try:
        have = {f.name: f.dataType for f in spark.read.parquet(folder).schema}
    except Exception as e:  # noqa: BLE001 - whatever the store says, the table can't be used
        return False, f"unreadable: {type(e).__name__}"
    want = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    wrong = sorted(n for n, kind in want.items() if have.get(n) != kind)
    return (False, "foreign: " + ", ".join(wrong)) if wrong else (True, "")


def refresh(spark: SparkSession, root: str, cache: str, index: str, key: str, schema: str, build: Callable[[DataFrame], DataFrame], pattern: str = "*.md") -> int:
    """Bring the versioned index up to the files below root; returns how many files were built anew.

    build takes (path) rows and returns index rows with their path, one a key. Rows of files that changed or are gone
    go, all others stay as they are. The index holds when each of its files was built, so a refresh that failed after
    its scan is made up for by the next one.
    """
    files, _ = scan(spark, root, cache, pattern)
    kinds = f"{schema}, built timestamp"
    base = versions.latest(spark, index)
    old = versions.snapshot(spark, index, key, kinds, base)
    built = old.groupBy("path").agg(F.min("built").alias("built"))
    stale = files.join(built, "path", "left").where("built is null or built <> modified").select("path", "modified")
    n = stale.count()
    left = old.join(files.select("path"), "path", "left_anti")
    if not n and left.isEmpty():
        return 0
    new = build(stale.select("path")).join(stale.withColumnRenamed("modified", "built"), "path")
    lost = old.join(stale.select("path"), "path", "left_semi").unionByName(left).select(key).join(new.select(key), key, "left_anti")
    columns = [c.split()[0] for c in kinds.split(", ")]
    versions.commit(spark, index, new.select(*columns), key, base, read=old.select(key), gone=lost)
    return n
