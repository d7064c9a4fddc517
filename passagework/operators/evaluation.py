"""How well a search answers a labelled question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import normalised
from passagework.operators import ranking


def is_echo(kind: Column, path: Column, text: Column, question: Column) -> Column:
    """A raw chat passage that holds the question itself: the question asked, not an answer."""
    raw = (F.lower(F.coalesce(kind, F.lit(""))) == "chat-raw") | F.contains(path, F.lit("chat-raw"))
    return raw & (F.length(normalised(question)) >= 12) & F.contains(normalised(text), normalised(question))


def matches(expected: Column, source: Column, path: Column) -> Column:
    """Whether a file is one of the expected (array<struct<source, name>>): by its stem in any source ("*"), or by source and path."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")
    return F.exists(expected, lambda e: ((e["source"] == "*") & (e["name"] == stem)) | ((e["source"] == source) & (e["name"] == path)))


def scored(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, answerable, confirmed, found, rank, files, echo) of every question.

    questions has qid, question, answerable (yes, partial, no), confirmed and expected; evidence has qid, place, source_id,
    path, kind and shown. rank is that of the first expected file among the files that the evidence names, each once.
    """
    asked = evidence.join(questions.select("qid", "question", "expected"), "qid")
    once = ranking.top(asked, ["qid", "source_id", "path"], [F.asc("place")], 1, "_one")
    files = once.withColumn("file", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    hit = matches(F.col("expected"), F.col("source_id"), F.col("path"))
    ranks = files.groupBy("qid").agg(F.min(F.when(hit, F.col("file"))).alias("rank"), F.count(F.lit(1)).alias("files"))
    echo = asked.groupBy("qid").agg(F.count_if(is_echo(F.col("kind"), F.col("path"), F.col("shown"), F.col("question"))).alias("echo"))
    rows = questions.select("qid", "answerable", "confirmed").join(ranks, "qid", "left").join(echo, "qid", "left")
    return rows.select("qid", "answerable", "confirmed", F.col("files").isNotNull().alias("found"), "rank", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("echo", F.lit(0)).alias("echo"))


def payloads(formatted: DataFrame, evidence: DataFrame, grounding: int, state: int) -> DataFrame:
    """(qid, total, grounding, state, passages, other): the characters that a reader gets for each question, and where they go.

    grounding and state are the sizes of the fixed instructions and of the search state, which stand in front of the text.
    """
    said = evidence.groupBy("qid").agg(F.sum(F.length("shown")).alias("passages"))
    total = (F.length("text") + grounding + state).cast("long")
    rows = formatted.join(said, "qid").select("qid", total.alias("total"), F.lit(grounding).cast("long").alias("grounding"), F.lit(state).cast("long").alias("state"), "passages")
    return rows.withColumn("other", F.col("total") - F.col("grounding") - F.col("state") - F.col("passages"))


def summary(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row: hits at 1 and 3, mean reciprocal rank and false "nothing found" of the answerable questions, right ones of the others, and mean sizes."""
    asks, none = F.col("answerable") != "no", F.col("answerable") == "no"
    mean = lambda c: F.round(F.avg(c), 6)
    found = rows.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("confirmed").alias("confirmed"), F.count_if(asks).alias("answerable"),
        F.count_if(asks & (F.col("rank") == 1)).alias("hit1"), F.count_if(asks & (F.col("rank") <= 3)).alias("hit3"), mean(F.when(asks, F.coalesce(1 / F.col("rank"), F.lit(0.0)))).alias("mrr"),
        F.count_if(asks & ~F.col("found")).alias("false_none"), F.count_if(none).alias("unanswerable"), F.count_if(none & ~F.col("found")).alias("abstained"), F.count_if(F.col("echo") > 0).alias("echo_questions"),
    )
    if sizes is None:
        return found
    parts = sizes.agg(mean(F.col("total")).alias("payload_mean"), F.max("total").alias("payload_max"), *(mean(F.col(c)).alias(f"{c}_mean") for c in ("passages", "other")))
    return found.join(F.broadcast(parts))


def saved(evidence: DataFrame, path: str) -> None:
    """Keep the raw results, so that they can be scored again."""
    evidence.write.mode("error").parquet(path)


def replayed(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Saved results scored by the present rules, without a search; questions that have no result are left out."""
    held = evidence.select("qid").distinct()
    return scored(questions.join(held, "qid", "left_semi"), evidence)
