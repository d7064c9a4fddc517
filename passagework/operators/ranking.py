"""Ranks, fusion of branches, pools and the budgeted selection of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import squeezed
from passagework.operators.tables import written

RRF_K = 60


def top(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked from 1; the order must end in a key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(rank, place).where(F.col(rank) <= n)


def numbered(rows: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """All rows with their place from 1 in their group, or in all if by is empty, by an order that ends in a key.

    Rows are dealt out by ranges of group and order and written; each range counts on from those before it, so neither
    a large group nor an order of all rows meets in one task. Null groups are a group; empty tables stay empty.
    """
    keys = [F.col(f"`{c}`") for c in by]
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0")
    begins = begins.select(F.col("_range").alias("_r"), "_before", *(F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    placed = ranged.withColumn("_inside", inside).join(begins, same, "left")
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(rank))


def fused(branches: list[DataFrame], key: list[str], n: int, question: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked branches (question, key..., rank): the sum of 1 / (k + rank), best n.

    rrf decides ranks and is rounded to 10 decimals; raw is what it was before.
    """
    ranked = branches[0].select(question, *key, "rank")
    for b in branches[1:]:
        ranked = ranked.unionByName(b.select(question, *key, "rank"))
    score = ranked.groupBy(question, *key).agg(F.sum(1 / (k + F.col("rank"))).alias("raw")).withColumn("rrf", F.round("raw", 10))
    return top(score, [question], [F.desc("rrf"), *(F.asc(c) for c in key)], n)


def pooled(rows: DataFrame, question: str, key: list[str], variant: str, rank: str, n: int) -> DataFrame:
    """Union of query variants: each row where it came first, by variant and rank, at most n a question."""
    first = top(rows, [question, *key], [F.asc(variant), F.asc(rank)], 1, "_first").drop("_first")
    return top(first, [question], [F.asc(variant), F.asc(rank), *(F.asc(c) for c in key)], n, "place")


def within_budget(rows: DataFrame, group: str, order: str, doc: str, text: str, top_k: int, max_chars: int, per_doc: int) -> DataFrame:
    """Evidence of each group in order: no repeated text, at most per_doc of a document, within max_chars and top_k.

    Rows (group, order, doc, text) are few a group, being the best of a search already. A row that doesn't fit is
    skipped and a later one may fit; only the first may be cut to the budget. Returns group, place from 1, the order,
    doc, shown text and truncated.
    """
    seen = F.struct("order_", "doc", "text", "norm")
    lists = rows.select(group, F.col(order).alias("order_"), F.col(doc).alias("doc"), F.col(text).alias("text"), squeezed(F.col(text)).alias("norm"))
    lists = lists.groupBy(group).agg(F.array_sort(F.collect_list(seen)).alias("rows"))
    doc_type = rows.schema[doc].dataType.simpleString()
    order_type = rows.schema[order].dataType.simpleString()
    kept_type = f"array<struct<order_:{order_type},doc:{doc_type},text:string,norm:string,truncated:boolean>>"

    def step(acc: Column, x: Column) -> Column:
        kept, size = acc["kept"], acc["size"]
        full = F.size(kept) >= top_k
        repeated = F.exists(kept, lambda k: k["norm"] == x["norm"])
        crowded = F.size(F.filter(kept, lambda k: k["doc"] == x["doc"])) >= per_doc
        too_long = (size + F.length(x["text"]) > max_chars) & (F.size(kept) > 0)
        shown = F.substring(x["text"], F.lit(1), F.lit(max_chars) - size)
        one = F.struct(x["order_"].alias("order_"), x["doc"].alias("doc"), shown.alias("text"), x["norm"].alias("norm"), (F.length(x["text"]) > max_chars - size).alias("truncated"))
        return F.when(full | repeated | crowded | too_long, acc).otherwise(F.struct(F.array_append(kept, one).alias("kept"), (size + F.length(shown)).alias("size")))

    zero = F.struct(F.array().cast(kept_type).alias("kept"), F.lit(0).alias("size"))
    folded = lists.select(group, F.posexplode(F.aggregate("rows", zero, step, lambda acc: acc["kept"])).alias("i", "k"))
    return folded.select(group, (F.col("i") + 1).alias("place"), F.col("k.order_").alias("order"), F.col("k.doc").alias(doc), F.col("k.text").alias("shown"), F.col("k.truncated").alias("truncated"))


def within_running_size(rows: DataFrame, by: list[str], order: str, size: Column, most: int, block: int = 1000) -> DataFrame:
    """Rows of each group by a whole-number order while their running size is at most `most`.

    Sizes are summed by blocks of the order first, so a group of any size is cut to the blocks that begin within
    the limit before its rows are put in order.
    """
    sized = rows.withColumns({"_size": size, "_block": F.floor(F.col(order) / block)})
    sums = sized.groupBy(*by, "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_before") <= most).drop("_sum")
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = sized.join(begins, [*by, "_block"]).withColumn("running", F.col("_before") + F.sum("_size").over(inside))
    return found.where(F.col("running") <= most).drop("_size", "_block", "_before")


def within_running_total(rows: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """All rows in one order while their running size is at most `most`, with that size in `running`.

    Rows are dealt out by ranges of the order. A range keeps what may fit on its own and the first row that doesn't;
    the sums of the ranges before it decide what does.
    """
    ranged = rows.withColumn("_size", size).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = written(ranged.withColumn("_own", F.sum("_size").over(inside)).where(F.col("_own") <= most + F.col("_size")))
    sums = own.groupBy("_range").agg(F.max("_own").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    found = own.where(F.col("_own") <= most).join(F.broadcast(before), "_range").withColumn("running", F.col("_before") + F.col("_own"))
    return found.where(F.col("running") <= most).drop("_size", "_range", "_own", "_before")
