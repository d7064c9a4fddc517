"""Meetings: quotes found in transcript lines, which recogniser's side to keep, loops and made-up lines, parts and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import clock, masked, once, spoken
from passagework.operators import ranking

#: Kinds of items that a meeting's extraction may give.
TYPES = ("summary", "decision", "fact", "preference", "open_item")
#: A side that one recogniser heard less than this share of keeps the other's lines.
HEARD = 0.3
#: A made-up line is short and holds one of these phrases (fixed values).
MADE_UP_WORDS = 10
MADE_UP = r"altyaz[ıi]|izlediğiniz için|abone olmayı unutmayın|^\W*abone ol\w*\W*$|\bm\.\s?k\.|thanks? (you )?for watching|subtitles? by"


def folded(text: Column) -> Column:
    """Letters without the marks of Turkish spelling."""
    return F.translate(text, "çğıöşüâîû", "cgiosuaiu")


def located(items: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """(item columns, line, speaker, at, said) of items (by, item_id, quote, cited) whose quote a transcript line (by, n, speaker, at, text) says.

    Quotes of under three words are found nowhere. The cited line comes first, then the others in order; a line may
    say the quote with or without the marks of Turkish letters, and `said` is how it says it. A quote meets the lines
    that hold its least frequent word, so a meeting's lines aren't tried against all of its quotes.
    """
    quote = items.withColumn("_q", spoken(F.col("quote"))).where(F.size(F.split("_q", " ")) >= 3)
    line = lines.withColumn("_l", spoken(masked(F.col("text"))))
    words = lambda c: F.array_distinct(F.split(folded(F.col(c)), " "))
    posted = line.select(by, "n", F.explode(words("_l")).alias("_w"))
    often = posted.groupBy(by, "_w").agg(F.count(F.lit(1)).alias("_df"))
    # the first and the last word of a quote may be parts of longer ones in the line, those between can't be
    inner = quote.select(by, "item_id", F.explode(F.slice(F.split(folded(F.col("_q")), " "), F.lit(2), F.size(F.split("_q", " ")) - 2)).alias("_w")).distinct()
    rare = inner.join(often, [by, "_w"]).groupBy(by, "item_id").agg(F.min_by("_w", F.struct("_df", "_w")).alias("_w"))
    pairs = rare.join(posted, [by, "_w"]).select(by, "item_id", "n")
    met = pairs.join(quote, [by, "item_id"]).join(line.select(by, "n", "speaker", "at", "_l"), [by, "n"])
    hit = met.withColumn("_at", F.instr(folded(F.col("_l")), folded(F.col("_q")))).where("_at > 0").withColumn("said", F.substring(F.col("_l"), F.col("_at"), F.length("_q")))
    best = ranking.top(hit, [by, "item_id"], [F.desc(F.coalesce(F.col("n") == F.col("cited"), F.lit(False))), F.asc("n")], 1, "_first")
    return best.select(*items.columns, F.col("n").alias("line"), "speaker", "at", "said")


def checked(items: DataFrame, lines: DataFrame, by: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Located items of known types with a statement, each type and statement once, the first by item_id."""
    found = located(items.where(F.col("type").isin(*types) & (F.trim("statement") != "")), lines, by)
    key = F.concat(F.col("type"), F.lower(F.trim(F.regexp_replace("statement", r"\s+", " "))))
    return ranking.top(found.withColumn("_key", key), [by, "_key"], [F.asc("item_id")], 1, "_first").drop("_first", "_key")


def chosen_sides(fresh: DataFrame, earlier: DataFrame, by: str, share: float = HEARD) -> DataFrame:
    """Lines (by, speaker, n, text) of the new recogniser, but those of the earlier one for a side that the new one heard under `share` of."""
    count = lambda rows, name: rows.groupBy(by, "speaker").agg(F.sum(F.size(F.filter(F.split(spoken(F.col("text")), " "), lambda w: w != ""))).alias(name))
    both = count(earlier, "heard").where("heard > 0").join(count(fresh, "got"), [by, "speaker"], "left")
    kept = both.where(F.coalesce("got", F.lit(0)) < share * F.col("heard")).select(by, "speaker")
    return fresh.join(kept, [by, "speaker"], "left_anti").withColumn("earlier", F.lit(False)).unionByName(earlier.join(kept, [by, "speaker"], "left_semi").withColumn("earlier", F.lit(True)))


def longest_run(text: Column) -> Column:
    """How many times in a row the most repeated phrase of one to four words comes.

    For each length n a word that equals the one n places on continues a run; a run of r such words is r // n repeats more.
    """
    words = F.regexp_extract_all(F.lower(F.translate(text, "İI", "iı")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def runs(words: Column, n: int) -> Column:
        same = F.transform(F.slice(words, 1, F.greatest(F.size(words) - n, F.lit(0))), lambda w, i: w == F.get(words, i + n))
        step = lambda acc, hit: F.struct(F.when(hit, acc["now"] + 1).otherwise(0).alias("now"), F.greatest(acc["best"], F.when(hit, acc["now"] + 1).otherwise(0)).alias("best"))
        return F.aggregate(same, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda acc: F.floor(acc["best"] / n).cast("int") + 1)

    return once(words, lambda w: F.greatest(*(runs(w, n) for n in (1, 2, 3, 4))))


def made_up(text: Column) -> Column:
    """Whether a line is what recognisers make of silence."""
    low = F.lower(F.translate(text, "İI", "iı"))
    return (F.size(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))) <= MADE_UP_WORDS) & (F.lower(text).rlike("(?U)" + MADE_UP) | low.rlike("(?U)" + MADE_UP))


def loop_windows(loops: DataFrame, segments: DataFrame, by: str, pad: int = 15) -> DataFrame:
    """(by, loop_id, segment_id): segments (by, segment_id, start, end) that overlap a loop's padded window, by an equal join on buckets of time.

    Each side is dealt into the buckets that it touches; a pair counts in the first bucket that both touch.
    """
    size = 60
    bucket = lambda c: F.floor(c / size)
    a = loops.select(by, "loop_id", (F.col("start") - pad).alias("lo"), (F.col("end") + pad).alias("hi"))
    a = a.withColumn("_b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    b = segments.select(by, "segment_id", "start", "end").withColumn("_b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    first = F.col("_b") == F.greatest(bucket(F.col("lo")), bucket(F.col("start")))
    return a.join(b, [by, "_b"]).where(first & (F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi"))).select(by, "loop_id", "segment_id")


def first_points(points: DataFrame, parts: DataFrame, by: str, most: int = 8) -> DataFrame:
    """The first points of every part: points (by, line, ...) belong to the last part (by, start) that begins at or before them, and a meeting's parts share `most`.

    A point before every part belongs to none but counts as the first part's.
    """
    each = parts.groupBy(by).agg(F.array_sort(F.collect_list("start")).alias("_starts"))
    part = F.size(F.filter("_starts", lambda s: s <= F.col("line")))
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) / F.size("_starts")))
    rows = points.join(each, by).withColumn("part", part).withColumn("_quota", quota)
    place = F.row_number().over(Window.partitionBy(by, "part").orderBy("line"))
    return rows.withColumn("_place", place).where("_place <= _quota").drop("_place", "_quota", "_starts")


def minutes(seconds: Column) -> Column:
    """Whole minutes of a meeting, at least one."""
    return F.greatest(F.lit(1), F.bround(seconds / 60).cast("int"))


def shifted(segments: DataFrame, by: str, offsets: DataFrame) -> DataFrame:
    """Segments of windows in the time of the whole recording: start and end moved by the window's own start (by, offset)."""
    return segments.join(offsets, by).withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")}).drop("offset")


def transcript_lines(lines: DataFrame, by: str, labels: dict[str, str]) -> DataFrame:
    """(by, n, text): numbered Markdown lines of a transcript (by, start, speaker, text), in the order of their starts."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("start", "speaker", "text"))
    label = F.coalesce(*(F.when(F.col("speaker") == k, v) for k, v in labels.items()), F.col("speaker"))
    return lines.withColumn("n", n).select(by, "n", F.concat(F.lit("- **["), F.col("n").cast("string"), F.lit(" · "), clock(F.col("start")), F.lit("] "), label, F.lit(":** "), F.col("text")).alias("text"))


def exchange_text(i: Column, user: Column, assistant: Column) -> Column:
    """An exchange as it is shown to an extractor, secrets masked."""
    return F.concat(F.lit("["), i.cast("string"), F.lit("] OWNER: "), masked(F.coalesce(user, F.lit(""))), F.lit("\nASSISTANT: "), masked(F.coalesce(assistant, F.lit(""))))


def listed(meetings: DataFrame, states: DataFrame, most: int = 100) -> DataFrame:
    """The newest meetings (path, day) with their status: the job's own state (path, state), else summarised or recorded by `summary`."""
    rows = meetings.join(states.select("path", "state"), "path", "left").withColumn("status", F.coalesce("state", F.when(F.col("summary"), "summarised").otherwise("recorded"))).drop("state")
    return rows.orderBy(F.desc("day"), F.desc("path")).limit(most)
