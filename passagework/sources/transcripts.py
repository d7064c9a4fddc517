"""Chat transcripts in JSON lines, and numbered meeting transcripts in notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, pos, line) of every .jsonl file below path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    thread = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    return files.select(thread.alias("thread_id"), F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("trim(line) <> ''")


def turns(lines: DataFrame) -> DataFrame:
    """(thread_id, pos, role, text, at): what was said, from both clients' formats.

    Side chains, meta lines and compaction summaries are left out, as are tool calls and texts that the client's own
    harness wrote. A message's text is its string, or its text parts on lines of their own.
    """
    get = lambda p: F.get_json_object("line", p)
    parts = F.from_json(F.coalesce(get("$.message.content"), get("$.payload.content")), "array<struct<type:string,text:string>>")
    listed = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    plain = F.coalesce(get("$.message.content"), get("$.payload.content"))
    text = F.when(plain.startswith("["), listed).otherwise(plain)
    role = F.when(get("$.type").isin("user", "assistant"), get("$.type")).when(get("$.type") == "response_item", get("$.payload.role"))
    hidden = F.coalesce(get("$.isSidechain"), F.lit("false")).eqNullSafe("true") | F.coalesce(get("$.isMeta"), F.lit("false")).eqNullSafe("true") | F.coalesce(get("$.isCompactSummary"), F.lit("false")).eqNullSafe("true")
    clean = F.trim(F.regexp_replace(text, r"(?s)<(system-reminder|command-[a-z]+)>.*?</\1>", ""))
    said = lines.where(~hidden).select("thread_id", "pos", role.alias("role"), clean.alias("text"), F.try_to_timestamp(get("$.timestamp")).alias("at"))
    return said.where(F.col("role").isin("user", "assistant") & (F.col("text") != "") & ~F.col("text").startswith("<"))


def titled(lines: DataFrame, kinds: list[str], field: str = "title") -> DataFrame:
    """(thread_id, title): the last value that lines of the first kind with any give, kinds in order of preference."""
    kind = F.get_json_object("line", "$.type")
    rank = F.array_position(F.array(*map(F.lit, kinds)), kind)
    rows = lines.where(kind.isin(*kinds)).select("thread_id", rank.alias("rank"), "pos", F.get_json_object("line", f"$.{field}").alias("title")).where("title is not null")
    return rows.groupBy("thread_id").agg(F.max_by("title", F.struct(-F.col("rank"), "pos")).alias("title"))


def meeting_lines(notes: DataFrame) -> DataFrame:
    """(path, n, start, speaker, text) of the numbered lines `- **[n · m:ss] speaker:** text` of notes (path, body)."""
    from passagework.functions.text import seconds

    pattern = r"^- \*\*\[(\d+) · ([\d:]+)\] ([^:*]+):\*\* (.*)$"
    line = notes.select("path", F.explode(F.split("body", "\n")).alias("l")).where(F.col("l").rlike(pattern))
    part = lambda k: F.regexp_extract("l", pattern, k)
    return line.select("path", part(1).cast("int").alias("n"), seconds(part(2)).cast("double").alias("start"), part(3).alias("speaker"), part(4).alias("text"))
