"""Keeping an index in step with its documents: snapshots, differences, reuse, renames, corrections, eligibility."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(docs: DataFrame, source: str, path: str, text: str) -> DataFrame:
    """(source_id, path, digest): SHA-256 of every document's text."""
    return docs.select(F.col(source).alias("source_id"), F.col(path).cast("string").alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))


def difference(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(source_id, path, status): added, changed, removed or unchanged, by a full outer join on the key."""
    old, new = manifest.withColumnRenamed("digest", "old"), current.withColumnRenamed("digest", "new")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return old.join(new, ["source_id", "path"], "full_outer").select("source_id", "path", status.alias("status"))


def health(differences: DataFrame) -> DataFrame:
    """One row: counts by status, and fresh, or stale if anything differs."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    got = differences.agg(count("added"), count("changed"), count("removed"), count("unchanged"))
    return got.withColumn("state", F.when(F.expr("added + changed + removed = 0"), "fresh").otherwise("stale"))


def reused(passages: DataFrame, cache: DataFrame, pack: DataFrame, text: str, vector: str = "vector") -> DataFrame:
    """The passages with a vector from the cache, else from a shipped pack, else none; `origin` says which.

    Cache and pack have (key, vector), key being SHA-256 of the text; each key is used once.
    """
    keyed = passages.withColumn("key", F.sha2(F.col(text), 256))
    a = cache.groupBy("key").agg(F.first(vector).alias("_a"))
    b = pack.groupBy("key").agg(F.first(vector).alias("_b"))
    both = keyed.join(a, "key", "left").join(b, "key", "left")
    origin = F.when(F.col("_a").isNotNull(), "cache").when(F.col("_b").isNotNull(), "pack").otherwise("embed")
    return both.withColumns({vector: F.coalesce("_a", "_b"), "origin": origin}).drop("_a", "_b")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, digest, old_path, new_path, verdict) of files that are gone and files that are fresh.

    A digest that is gone once and fresh once is a move; one that is gone or fresh more often is ambiguous and has
    its smallest paths; digests are counted before they meet, so copies make no pairs.
    """
    gone = old.join(new.select("source_id", "path"), ["source_id", "path"], "left_anti")
    fresh = new.join(old.select("source_id", "path"), ["source_id", "path"], "left_anti")
    count = lambda df, name: df.groupBy("source_id", "digest").agg(F.min("path").alias(f"{name}_path"), F.count(F.lit(1)).alias(f"n_{name}"))
    both = count(gone, "old").join(count(fresh, "new"), ["source_id", "digest"])
    return both.withColumn("verdict", F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), "moved").otherwise("ambiguous"))


def corrections(records: DataFrame, claims: DataFrame) -> DataFrame:
    """(record_id, path, state, superseded_by, current): each record under the claims that are made on it.

    A claim names a record_id, or else a path with the digest it had. One claim makes the record corrected and no
    longer current; several on one record conflict and change nothing.
    """
    by_id = claims.where("target_id is not null").select(F.col("claim_id"), F.col("target_id").alias("record_id"))
    by_path = claims.where("target_id is null").join(records.select("record_id", F.col("path").alias("target_path"), F.col("digest").alias("target_digest")), ["target_path", "target_digest"])
    each = by_id.unionByName(by_path.select("claim_id", "record_id")).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("claim"))
    both = records.join(each, "record_id", "left")
    one = F.coalesce(F.col("n"), F.lit(0)) == 1
    state = F.when(one, "corrected").when(F.col("n") > 1, "conflict").otherwise("accepted")
    return both.select("record_id", "path", state.alias("state"), F.when(one, F.col("claim")).alias("superseded_by"), (~one).alias("current"))


def eligible(indexed: DataFrame, live: DataFrame, states: DataFrame, drafts: bool = False, history: bool = False) -> DataFrame:
    """Indexed files whose live digest is the indexed one and whose state may be shown."""
    same = indexed.join(live, ["source_id", "path", "digest"], "left_semi").join(states, ["source_id", "path"], "left")
    state = F.coalesce("state", F.lit("imported"))
    shown = state != "rejected"
    if not drafts:
        shown &= state != "draft"
    if not history:
        shown &= ~state.isin("superseded", "corrected")
    return same.where(shown)


def publish(df: DataFrame, folder: str, version: int, valid: Callable[[DataFrame], bool] = lambda _: True) -> str:
    """Write a version of a table under folder and then name it in _CURRENT, so a reader sees a whole version or the one before.

    A version is written once, so what a reader has open never changes; it is read back and must be valid before it is
    named. The pointer is a one-row table that is written last; read_current() follows the largest version named.
    """
    path = f"{folder}/v={version}"
    df.write.mode("error").parquet(path)
    if not valid(df.sparkSession.read.parquet(path)):
        raise ValueError(f"version {version} isn't valid and stays unpublished")
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{folder}/_current")
    return path


def read_current(spark, folder: str) -> DataFrame:
    version = spark.read.parquet(f"{folder}/_current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/v={version}")


def write_pack(vectors: DataFrame, folder: str, fingerprint: str) -> None:
    """A shippable table of (key, vector), a row for each text, with the fingerprint of the embedding that made it."""
    vectors.dropDuplicates(["key"]).select("key", "vector", F.lit(fingerprint).alias("fingerprint"), F.size("vector").alias("dim")).write.mode("overwrite").parquet(folder)


def load_pack(spark, folder: str, fingerprint: str) -> DataFrame:
    """(key, vector) of a pack that the same embedding made; vectors of a wrong size are left out."""
    pack = spark.read.parquet(folder)
    return pack.where((F.col("fingerprint") == fingerprint) & (F.size("vector") == F.col("dim"))).select("key", "vector")


def one_dimension(vectors: DataFrame, vector: str = "vector") -> bool:
    """Whether all vectors have one size; an index of several is refused."""
    return vectors.agg(F.count_distinct(F.size(vector))).first()[0] <= 1
