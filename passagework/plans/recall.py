"""A question to cited evidence, from notes to the budgeted rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import citation, shortened
from passagework.functions.timeframe import Timeframe, parse, passage_date, topic_words
from passagework.operators import lexical, passages, ranking, vectors
from passagework.operators.tables import written

#: What a caller may ask for at most.
CEILINGS = {"top_k": 20, "max_chars": 20_000, "max_per_document": 10}
#: Query variants of a question, and rows of its pool with them.
MOST_VARIANTS, POOL = 4, 32
#: Characters of a passage when a time range is listed, so that more of the range fits the budget.
LISTED = 600
#: Kinds of notes that hold raw material (fixed values).
RAW_KINDS = ("chat-raw", "source", "clip", "meeting")


@dataclass(frozen=True)
class Budget:
    top_k: int = 6
    max_chars: int = 7000
    max_per_document: int = 2

    def lowered(self, **asked: int) -> Budget:
        """What a caller asked for, where that is less; unknown names and what isn't a whole number above 0 are refused."""
        for k, v in asked.items():
            if k not in CEILINGS or isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"invalid budget: {k}={v!r}")
        return Budget(**{k: min(getattr(self, k), ceiling, asked.get(k, ceiling)) for k, ceiling in CEILINGS.items()})


def chunked(notes: DataFrame) -> DataFrame:
    """Passages (chunk_id, source_id, path, title, heading, text) of notes (source_id, path, title, body, and summary where there is one)."""
    summary = F.col("summary") if "summary" in notes.columns else F.lit(None).cast("string")
    rows = passages.passages_of(notes.select("source_id", "path", "title", summary.alias("summary"), "body"))
    return rows.select(F.concat_ws("#", "source_id", "path", F.format_string("%06d", "chunk_no")).alias("chunk_id"), "source_id", "path", "title", "heading", "text")


def visible(asked: list[str] | None, allowed: list[str] | None) -> list[str] | None:
    """The sources a scoped caller reads. None is all; an empty scope, and a source outside it, are refused alike."""
    if allowed is None:
        return asked
    if not allowed:
        raise ValueError("no visible sources")
    if asked and set(asked) - set(allowed):
        raise ValueError("unknown source ids")
    return list(dict.fromkeys(asked or allowed))


def scoped(rows: DataFrame, sources: list[str] | None) -> DataFrame:
    """None is all sources; an empty list shows nothing."""
    return rows if sources is None else rows.where(F.col("source_id").isin(*sources) if sources else F.lit(False))


def servable(files: DataFrame, drafts: bool = False, history: bool = False) -> DataFrame:
    """The files (source_id, path, state, current, pending) that recall may serve: not rejected; drafts and superseded ones on demand."""
    waits = (F.col("state") == "draft") | F.coalesce(F.col("pending"), F.lit(False))
    return files.where((F.coalesce("state", F.lit("imported")) != "rejected") & (~F.coalesce(waits, F.lit(False)) | F.lit(drafts)) & (F.coalesce("current", F.lit(True)) | F.lit(history)))


def candidates(index: DataFrame, questions: DataFrame, sources: list[str] | None = None, branch: int = 20, pool: int = 18, dim: int = 0, eligible: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, rank, rrf, raw): the fused best passages of questions (qid, question).

    Words of five or more characters match by their stem too. Statistics cover the whole index; the scope and the
    eligible files (source_id, path) come after the scores, but before the limits. With dim, hashed vectors rank the
    passages that have a lexical hit as a second branch; they never add others.
    """
    asked = passages.query_terms(questions, "qid", "question", prefixes=True)
    open_ = None
    if sources is not None or eligible is not None:
        open_ = scoped(index.select("chunk_id", "source_id", "path"), sources)
        open_ = open_ if eligible is None else open_.join(eligible.select("source_id", "path"), ["source_id", "path"], "left_semi")
    first = lexical.best(index, "chunk_id", "text", asked, "qid", branch, open_)
    branches = [first]
    if dim:
        v = vectors.hash_embedding(index.join(first.select("chunk_id").distinct(), "chunk_id").withColumn("chunk", F.xxhash64("chunk_id")), "chunk", "text", dim)
        q = vectors.hash_embedding(questions.withColumn("q", F.xxhash64("qid")), "q", "question", dim)
        pair = first.select("qid", "chunk_id", F.xxhash64("chunk_id").alias("chunk"), F.xxhash64("qid").alias("q"))
        dot = F.aggregate(F.zip_with("x", "y", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda a, x: a + x)
        both = pair.join(v.withColumnRenamed("vector", "x"), "chunk").join(q.withColumnRenamed("vector", "y"), "q").select("qid", "chunk_id", F.round(dot, 10).alias("cosine")).where("cosine >= 0.01")
        branches.insert(0, ranking.top(both, ["qid"], [F.desc("cosine"), F.asc("chunk_id")], branch))
    return ranking.fused(branches, ["chunk_id"], pool, "qid")


def with_variants(index: DataFrame, questions: DataFrame, variants: DataFrame, pool: int = 18, **options) -> DataFrame:
    """(qid, chunk_id, rank): candidates of the questions, then those of their variants (qid, variant from 1, question), each once, POOL a question at most."""
    extra = ranking.top(variants.where(F.trim("question") != ""), ["qid"], [F.asc("variant")], MOST_VARIANTS)
    every = questions.select("qid", F.lit(0).alias("variant"), "question").unionByName(extra.select("qid", F.col("variant").cast("int").alias("variant"), "question"))
    asked = every.select(F.concat_ws("\n", "qid", F.col("variant").cast("string")).alias("qid"), "question")
    own = F.substring_index("qid", "\n", 1).alias("qid")
    found = candidates(index, asked, pool=pool, **options).select(own, F.substring_index("qid", "\n", -1).cast("int").alias("variant"), "chunk_id", "rank")
    return ranking.pooled(found, "qid", ["chunk_id"], "variant", "rank", max(pool, POOL)).select("qid", "chunk_id", F.col("place").alias("rank"))


def selected(ranked: DataFrame, index: DataFrame, budget: Budget, top_k: int | None = None) -> DataFrame:
    """(qid, place, source_id, path, title, heading, citation, shown, truncated, rank) of ranked passages (qid, chunk_id, rank) within the budget."""
    rows = ranked.select("qid", "chunk_id", "rank").join(index, "chunk_id")
    rows = rows.withColumn("doc", citation(F.col("source_id"), F.col("path"), F.col("title")))
    kept = ranking.within_budget(rows, "qid", "rank", "doc", "text", top_k or budget.top_k, budget.max_chars, budget.max_per_document)
    about = rows.select("qid", F.col("rank").alias("order"), "source_id", "path", "title", "heading")
    return kept.join(about, ["qid", "order"]).select("qid", "place", "source_id", "path", "title", "heading", F.col("doc").alias("citation"), "shown", "truncated", F.col("order").alias("rank"))


def recall(
    index: DataFrame, questions: DataFrame, budget: Budget = Budget(), sources: list[str] | None = None, dim: int = 0, eligible: DataFrame | None = None,
    variants: DataFrame | None = None, gate: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Evidence for each question within the budget; see selected() for the columns.

    A gate gets (qid, question, chunk_id, source_id, path, text, rank) and returns the rows that pass, with their new rank.
    """
    options = {"sources": sources, "dim": dim, "eligible": eligible}
    best = candidates(index, questions, **options) if variants is None else with_variants(index, questions, variants, **options)
    if gate is not None:
        best = gate(best.select("qid", "chunk_id", "rank").join(index.select("chunk_id", "source_id", "path", "text"), "chunk_id").join(questions.select("qid", "question"), "qid"))
    return selected(best, index, budget)


def described(evidence: DataFrame, files: DataFrame, frame: Timeframe | None = None) -> DataFrame:
    """evidence with the record of its file: date, kind, state, current, and the day of its last commit.

    files has source_id, path, kind, state, current, created, dated, updated and committed; files that it lacks are
    imported and current.
    """
    own = files.select("source_id", "path", "kind", "state", "current", "created", "dated", "updated", "committed")
    met = evidence.join(own, ["source_id", "path"], "left").withColumn("date", _day(frame))
    return met.withColumns({"state": F.coalesce("state", F.lit("imported")), "current": F.coalesce("current", F.lit(True))}).drop("created", "dated", "updated")


def _day(frame: Timeframe | None) -> Column:
    return passage_date(F.col("heading"), F.col("path"), [F.col("created"), F.col("dated"), F.col("updated")], F.col("committed"), frame)


def dated(index: DataFrame, files: DataFrame, frame: Timeframe) -> DataFrame:
    """The passages that belong to the range, with their day and the kind of their file."""
    met = index.join(files.select("source_id", "path", "kind", "created", "dated", "updated", "committed"), ["source_id", "path"])
    return met.withColumn("day", _day(frame)).where(frame.contains(F.col("day"))).drop("created", "dated", "updated", "committed")


def is_written(kind: Column, path: Column) -> Column:
    """Whether a note was written up; raw chats, clips, sources and meetings weren't."""
    return ~(F.lower(F.coalesce(kind, F.lit(""))).isin(*RAW_KINDS) | F.contains(path, F.lit("chat-raw")))


def without_raw_of_written_days(rows: DataFrame, day: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    """rows (kind, path, day, ...) with written, less the raw ones of days that have a written one, within the columns `by`."""
    marked = rows.withColumn("written", is_written(F.col("kind"), F.col("path")))
    days = marked.where("written").select(*by, day).distinct()
    return marked.where("written").unionByName(marked.where("not written").join(days, [*by, day], "left_anti").select(*marked.columns))


def listing(rows: DataFrame) -> DataFrame:
    """(chunk_id, source_id, path, title, heading, text, truncated, day, rank) of dated passages: one a note, newest first.

    A note shows its own dated section of the range, else its summary, else its first passage; raw material only speaks
    for days without a written note. Texts are cut to LISTED characters.
    """
    told = F.coalesce(F.col("heading").rlike(r"^\d{4}"), F.lit(False))
    best = ranking.top(without_raw_of_written_days(rows), ["source_id", "path"], [F.desc("day"), F.desc(told), F.desc(F.col("heading") == "summary"), F.asc("chunk_id")], 1, "_first")
    shown = best.withColumns({"truncated": F.length("text") > LISTED, "text": shortened(F.col("text"), LISTED)})
    return ranking.numbered(shown.drop("_first"), [], [F.desc("day"), F.desc("written"), F.desc("path"), F.desc("source_id")]).drop("written", "kind")


def about_topic(rows: DataFrame, residual: str) -> DataFrame:
    """The rows about a question's words, by their first five characters: 6 for a word in title, heading or path, 1 for each of up to 4 in the text.

    Rows with less than half of the best score, or less than 2, are left out.
    """
    fold = lambda text: F.translate(F.lower(F.translate(text, "İI", "ii")), "ı", "i")
    stems = sorted({w[:5].replace("ı", "i") for w in topic_words(residual)})
    if not stems:
        return rows.where(F.lit(False))
    head, text = fold(F.concat_ws(" ", "title", "heading", "path")), fold(F.col("text"))
    times = lambda w: F.floor((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w))
    score = sum((F.when(F.contains(head, F.lit(w)), 6).otherwise(0) + F.least(times(w), F.lit(4)) for w in stems), F.lit(0))
    scored = rows.withColumn("topic_score", score)
    return scored.join(F.broadcast(scored.agg(F.max("topic_score").alias("_top")))).where(F.col("topic_score") >= F.greatest(F.lit(2.0), F.col("_top") / 2)).drop("_top")


def recall_in_time(index: DataFrame, files: DataFrame, question: str, today: dt.date, budget: Budget = Budget(), **options) -> DataFrame:
    """Evidence for one question that may name a time; see selected() for the columns, and in_range (null without a time).

    Of a question with a topic, passages of the range come first and then all others; where nothing answers, the notes
    of the range that share its words are listed. A question of no topic lists the range, of which twice as many fit.
    files is what described() takes.
    """
    spark = index.sparkSession
    frame = parse(question, today)
    ask = lambda text: spark.createDataFrame([("q", text)], "qid string, question string")
    if frame is None:
        return recall(index, ask(question), budget, **options).withColumn("in_range", F.lit(None).cast("boolean"))
    inside = dated(index, files, frame)
    if not frame.activity:
        here = inside.select("source_id", "path").distinct()
        near = candidates(index, ask(frame.residual), eligible=here, **options).join(inside.select("chunk_id"), "chunk_id", "left_semi")
        both = written(inside_first(near, candidates(index, ask(question), **options), ["qid"], ["chunk_id"]))
        if not both.isEmpty():
            return selected(both, index, budget).join(both.select("qid", "rank", "in_range"), ["qid", "rank"])
        inside = about_topic(inside, frame.residual).drop("topic_score")
    rows = listing(inside).withColumn("qid", F.lit("q"))
    return selected(rows.select("qid", "chunk_id", "rank"), rows.drop("qid", "rank"), budget, 2 * budget.top_k).withColumn("in_range", F.lit(True))


def inside_first(inside: DataFrame, outside: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, key, rank, in_range): ranked rows of the range, then the ranked others that aren't among them."""
    first = inside.select(*by, *key, "rank", F.lit(True).alias("in_range"))
    rest = outside.select(*by, *key, "rank", F.lit(False).alias("in_range")).join(first.select(*by, *key), [*by, *key], "left_anti")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("in_range"), F.asc("_rank"), *(F.asc(k) for k in key)))
    return first.unionByName(rest.select(*first.columns)).withColumnRenamed("rank", "_rank").withColumn("rank", place).drop("_rank")


def formatted(evidence: DataFrame) -> DataFrame:
    """(qid, text): the evidence of each question as one text, a citation's head once, before its first passage."""
    first = F.row_number().over(Window.partitionBy("qid", "citation").orderBy("place")) == 1
    head = F.when(first, F.concat(F.lit("# "), F.col("citation"), F.lit("\n"))).otherwise("")
    parts = evidence.select("qid", F.struct("place", F.concat(head, F.col("shown"), F.when(F.col("truncated"), " …").otherwise("")).alias("t")).alias("p"))
    return parts.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("p"))["t"], "\n\n").alias("text"))


def sources_of(evidence: DataFrame) -> DataFrame:
    """(qid, source_id, path, title, citation): the cited notes of each question, each once, in the order of their first passage."""
    first = ranking.top(evidence, ["qid", "source_id", "path"], [F.asc("place")], 1, "_first")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return first.withColumn("position", place).select("qid", "position", "source_id", "path", "title", "citation")
