"""Small Spark helpers that the operators share: settled tables, skew-proof lookups, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import once

#: A side is broadcast only up to this many narrow rows (two longs each, about 16 MB).
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="passagework-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends here, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, share: int = 1000) -> DataFrame:
    """Left join with a settled table that has one row a key; `rows` counts the rows of `left` with that key.

    Keys with more than 1/share of all rows are at most `share`, so they are broadcast and their rows stay
    where they are; the others are joined by a shuffle in which no key is large.
    """
    total, most = right.agg(F.sum(rows), F.max(rows)).first()
    bound = max(2000, (total or 0) // share)
    if (most or 0) <= bound:
        return left.join(right, key, "left")
    hot, cold = right.where(F.col(rows) > bound), right.where(F.col(rows) <= bound)
    spread = left.join(F.broadcast(hot), key, "inner")
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return spread.unionByName(others)


def running(values: Column, largest: bool = False, block: int = 64) -> Column:
    """For every element of an array of ints the sum, or the largest, of those before it (0 at first): blocks first, so no step copies an array."""
    both = (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x)
    total = lambda part: F.aggregate(part, F.lit(0), both)

    def summed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: total(F.slice(v, b * block + 1, block)))
        before = once(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))))
        return once(before, lambda begins: F.transform(v, lambda _, i: both(F.get(begins, (i / block).cast("int")), total(F.slice(v, i - i % block + 1, i % block)))))

    return once(values, lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(F.array().cast("array<int>")))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in the settled table ids (doc_id); ids are broadcast only if few, by count."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def own_ids(docs: DataFrame) -> bool:
    """Whether every row of docs has a doc_id that no other row has."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def text_digest() -> Column:
    """SHA-256 of the text after lower-casing A-Z only; null text is empty."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.sha2(low.cast("binary"), 256))


def one_each(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs by the decision on their doc_id and text: decided is settled and has doc_id, digest and kept, a row for each row of docs.

    Rows that aren't kept go; of repeated ones that are, the one whose JSON form is least stays. Ids may be null or
    repeated. Rows travel as one struct, so columns of any name and type, maps too, stay as they are.
    """
    counted = decided.groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = settled(counted.where("not stays or n > 1").drop("n"))
    few = marked.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("own") == F.col("of_digest"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_digest().alias("own"))
    met = rows.join(F.broadcast(marked) if few else marked, same, "left")
    repeated = met.where("stays").groupBy("id", "own").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return met.where("stays is null").select("row.*").unionByName(repeated.select("row.*"))


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, the columns of ids) for a bounded number of ids (doc_id, not repeated): the text of each, so no more rows than ids.

    The ids are broadcast, so other texts stay where they are. Of several texts of an id the one with the least SHA-256 counts; null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    met = docs.select("doc_id", F.struct(F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text")).alias("t")).join(F.broadcast(ids), "doc_id")
    return met.groupBy(*ids.columns).agg(F.min("t").alias("t")).select("doc_id", F.col("t.text").alias("text"), *(c for c in ids.columns if c != "doc_id"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
