"""Conversations and meetings: exchanges, marks, packing, quotes, later context, echoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import normalised, sentences, stems, tokens


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, i, user, assistant): a user turn opens an exchange, the last assistant text in it answers.

    turns has conv_id, turn, role and text; turns before the first user turn and other roles belong to none.
    """
    place = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("i", F.sum((F.col("role") == "user").cast("int")).over(place)).where("i > 0")
    text = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return numbered.groupBy("conv_id", "i").agg(text("user").alias("user"), F.coalesce(text("assistant"), F.lit("")).alias("assistant"))


def packed(rows: DataFrame, group: str, order: str, size: Column, limit: int, most: int | None = None) -> DataFrame:
    """(group, order, part): consecutive rows in parts of at most `limit`; a row that is longer is a part alone. Parts from `most` on are left out.

    Sizes alone are folded, in order, per conversation: one array of numbers a group, and one of where parts begin.
    """
    lists = rows.select(group, F.struct(F.col(order).alias("o"), size.cast("int").alias("n")).alias("x")).groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["n"] <= limit) | (acc["used"] == 0)
        begins = F.when(fits, acc["begins"]).otherwise(F.array_append(acc["begins"], acc["i"]))
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(x["n"]).alias("used"), (acc["i"] + 1).alias("i"), begins.alias("begins"))

    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("begins"))
    cut = lists.select(group, F.size("rows").alias("_n"), "rows", F.aggregate("rows", zero, step, lambda a: a["begins"]).alias("_begins"))
    end = F.coalesce(F.get("_begins", F.col("part") + 1), F.col("_n"))
    parts = cut.select(group, "rows", "_n", "_begins", F.posexplode("_begins").alias("part", "_begin"))
    found = parts.select(group, "part", F.explode(F.slice("rows", F.col("_begin") + 1, end - F.col("_begin"))).alias("p")).select(group, F.col("p.o").alias(order), "part")
    return found if most is None else found.where(F.col("part") < most)


def held_back(rows: DataFrame, group: str, order: str) -> DataFrame:
    """All but the newest row of each group: it may still be answered."""
    return rows.join(rows.groupBy(group).agg(F.max(order).alias("_last")), group).where(F.col(order) < F.col("_last")).drop("_last")


def with_two_before(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Each row with the texts of the two rows before it."""
    place = Window.partitionBy(group).orderBy(order)
    return rows.select("*", F.lag(text, 2).over(place).alias("before_2"), F.lag(text, 1).over(place).alias("before_1"))


def verified_quotes(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(item_id, i, speaker): where each item's quote stands in its conversation, verbatim but for case and white space.

    items has item_id, conv_id, exchange and quote; rows are exchanges. The cited exchange comes first, the owner's
    text before the assistant's; items without a quote in their conversation are dropped.
    """
    said = rows.select("conv_id", "i", F.explode(F.array(F.struct(F.lit(0).alias("who"), normalised(F.col("user")).alias("t")), F.struct(F.lit(1).alias("who"), normalised(F.col("assistant")).alias("t")))).alias("s"))
    asked = items.select("item_id", "conv_id", "exchange", normalised(F.col("quote")).alias("q")).where("q <> ''")
    hits = asked.join(said, "conv_id").where(F.contains(F.col("s.t"), F.col("q")))
    first = hits.groupBy("item_id").agg(F.min(F.struct((F.col("i") != F.col("exchange")).alias("other"), "i", F.col("s.who").alias("who"))).alias("b"))
    return first.select("item_id", F.col("b.i").alias("i"), F.when(F.col("b.who") == 0, "owner").otherwise("assistant").alias("speaker"))


def later_sharing(items: DataFrame, rows: DataFrame, limit: int = 12_000, shared: int = 2) -> DataFrame:
    """(item_id, i, size): only those later exchanges whose whole reply shares stems with the statement, within a size budget.

    Less than later_context(): exchanges that the owner alone settles are missing. The SQL of later_context_budget asks for this.
    """
    asked = items.select("item_id", "conv_id", "exchange", stems(F.col("statement")).alias("terms"))
    later = asked.join(rows, "conv_id").where("i > exchange")
    about = later.where(F.size(F.array_intersect("terms", stems(F.col("assistant")))) >= shared)
    sized = about.select("item_id", "i", (F.least(F.length("user"), F.lit(400)) + F.least(F.length("assistant"), F.lit(1500))).alias("size"))
    frame = Window.partitionBy("item_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("running", F.sum("size").over(frame)).where(F.col("running") <= limit)


def later_context(items: DataFrame, rows: DataFrame, limit: int = 12_000, shared: int = 2) -> DataFrame:
    """(item_id, i, owner, assistant, size, running): all exchanges after an item's own, newest first within a size budget.

    items has item_id, conv_id, exchange, statement, quote and keywords (an array); rows are exchanges. owner has the
    first 400 characters. assistant has the sentences that share a stem with the keywords, or `shared` of them with
    statement and quote, each with the sentence after it, 1,500 characters at most; it may be empty.
    An exchange that the owners' texts from it on alone put beyond the budget fits for no item, and isn't joined.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.substring(F.coalesce("user", F.lit("")), 1, 400)
    near = rows.select("conv_id", "i", owner.alias("owner"), "assistant").withColumn("_owners", F.sum(F.length("owner")).over(newest)).where(F.col("_owners") <= limit)
    said = F.transform(sentences(F.col("assistant")), lambda s: F.struct(s.alias("text"), stems(s).alias("stems")))
    asked = items.select("item_id", "conv_id", "exchange", stems(F.concat_ws(" ", "statement", "quote")).alias("terms"), stems(F.concat_ws(" ", "keywords")).alias("keys"))
    later = asked.join(near.select("conv_id", "i", "owner", said.alias("said")), "conv_id").where("i > exchange")

    def hit(s: Column) -> Column:
        return F.arrays_overlap(s["stems"], "keys") | (F.size(F.array_intersect(s["stems"], "terms")) >= shared)

    about = F.filter("said", lambda s, k: hit(s) | F.coalesce(hit(F.get("said", k - 1)), F.lit(False)))
    texts = later.select("item_id", "i", "owner", F.substring(F.array_join(F.transform(about, lambda s: s["text"]), " "), 1, 1500).alias("assistant"))
    frame = Window.partitionBy("item_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    sized = texts.withColumn("size", F.length("owner") + F.length("assistant"))
    return sized.withColumn("running", F.sum("size").over(frame)).where(F.col("running") <= limit)


def without_echo(lines: DataFrame, near: float = 10.0, share: float = 0.7, words: int = 4, short: float = 4.0) -> DataFrame:
    """Lines (meeting, n, start, speaker, text) without those of "me" that the other side said.

    A line of `words` or more different words is an echo if lines of "others" within `near` seconds have `share` of
    them; a shorter one of two or more if one line begun at most `short` before and 1 after it has them all. Lines
    meet in time buckets of `near` seconds, each line of the other side being dealt to three.
    """
    said = F.array_distinct(tokens(F.col("text"), 1))
    own = lines.where("speaker = 'me'").select("meeting", "n", "start", said.alias("w"), F.floor(F.col("start") / near).alias("bucket"))
    heard = lines.where("speaker = 'others'").select("meeting", F.col("start").alias("at"), said.alias("h"), F.explode(F.array(*(F.floor(F.col("start") / near) + k for k in (-1, 0, 1)))).alias("bucket"))
    met = own.join(heard, ["meeting", "bucket"]).where(F.abs(F.col("at") - F.col("start")) <= near)
    gap = F.col("start") - F.col("at")
    whole = (gap >= -1) & (gap <= short) & (F.size(F.array_except("w", "h")) == 0)
    per = met.groupBy("meeting", "n").agg(F.first("w").alias("w"), F.array_distinct(F.flatten(F.collect_list(F.array_intersect("w", "h")))).alias("both"), F.max(whole).alias("whole"))
    size = F.size("w")
    echo = per.where(((size >= words) & (F.size("both") >= share * size)) | ((size >= 2) & (size < words) & F.col("whole")))
    return lines.join(echo.select("meeting", "n"), ["meeting", "n"], "left_anti")


def collapsed(text: Column, least: int = 6) -> Column:
    """Phrases of one to four words that repeat `least` or more times in a row, said once."""
    unit = r"[\p{L}\p{N}_']+[,.!?]?"
    for n in range(1, 5):
        phrase = unit + rf"(?:\s+{unit}){{{n - 1}}}"
        text = F.regexp_replace(text, rf"(?iU)\b({phrase})(?:\s+\1){{{least - 1},}}(?=\s|$)", "$1")
    return text


def clean_lines(segments: DataFrame, most: int = 20_000) -> DataFrame:
    """Transcript lines (meeting, n, start, speaker, text): known speakers, times from 0, white space squeezed, in order."""
    ok = segments.where(F.col("speaker").isin("me", "others")).withColumn("start", F.greatest(F.col("start").cast("double"), F.lit(0.0)))
    ok = ok.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("start is not null and text <> ''")
    place = Window.partitionBy("meeting").orderBy("start", "speaker", "text")
    return ok.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).select("meeting", "n", "start", "speaker", "text")
