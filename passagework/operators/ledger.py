"""Proposals and their decisions on small keyed tables: idempotent appends, revision checks, diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def appended(ledger: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """The ledger with the events it lacks; an event that comes twice is taken once, the first by its content hash."""
    new = events.join(ledger.select(key), key, "left_anti")
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.xxhash64(*new.columns)).alias("e")).select("e.*")
    return ledger.unionByName(first)


def decided(records: DataFrame, requests: DataFrame) -> DataFrame:
    """records (record_id, revision, state) after requests (record_id, expected_revision, state), with `outcome`.

    A request takes effect only where the revision is the expected one, the record is still a draft, and no other
    request for the record asks for another state; then the revision rises by one.
    """
    asked = requests.groupBy("record_id").agg(F.count_distinct("state").alias("states"), F.min("state").alias("wanted"), F.min("expected_revision").alias("low"), F.max("expected_revision").alias("high"))
    both = records.join(asked, "record_id", "left")
    outcome = F.when(F.col("wanted").isNull(), "none").when((F.col("states") > 1) | (F.col("low") != F.col("high")), "conflict").when(
        F.col("low") != F.col("revision"), "stale").when(F.col("state") != "draft", "settled").otherwise("done")
    done = outcome == "done"
    return both.select(
        *(c for c in records.columns if c not in ("state", "revision")), F.when(done, F.col("wanted")).otherwise(F.col("state")).alias("state"),
        F.when(done, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), outcome.alias("outcome"))


def superseded(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """records with accepted corrections (record_id, content) appended as new current revisions and the old ones marked."""
    new = corrections.join(records.where("current"), "record_id").select("record_id", (F.col("revision") + 1).alias("revision"), corrections["content"].alias("content"), F.lit("accepted").alias("state"), F.lit(True).alias("current"))
    old = records.join(new.select("record_id").distinct().withColumn("_new", F.lit(True)), "record_id", "left")
    hit = F.coalesce("_new", F.lit(False)) & F.col("current")
    marked = old.select("record_id", "revision", "content", F.when(hit, "superseded").otherwise(F.col("state")).alias("state"), (F.col("current") & ~hit).alias("current"))
    return marked.unionByName(new)


def current(records: DataFrame) -> DataFrame:
    """One row a record: the current revision, else the highest."""
    best = records.groupBy("record_id").agg(F.max(F.struct("current", "revision", "state", "content")).alias("r"))
    return best.select("record_id", "r.revision", "r.state", "r.content", "r.current")


def diffs(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, diff): the unified diff of two texts of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = ["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "before", "after", lineterm="")) for x, y in zip(b[old], b[new], strict=True)]
            yield pd.DataFrame({key: b[key], "diff": text})

    return rows.select(key, old, new).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, diff string")
