"""Names of topics: words and word pairs of titles that are common in a group of notes and rare elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import once, plain_key

#: Of words: how common a term must be inside its group, how common it may be over all, how near its parts a pair must score.
FLOOR, COMMON, PAIR = 0.2, 0.1, 0.8
#: Words of a name, and the least score of a further one against the first.
WORDS, WEAK = 3, 0.5
_LETTER = "0-9a-zçğıöşüâîû"


def terms(text: Column, stop: list[str]) -> Column:
    """array<struct<key, word>>: words of three or more characters and pairs of neighbours; stop words break pairs, case endings behind an apostrophe go."""
    low = F.regexp_replace(F.lower(F.translate(text, "İ", "i")), r"['’][a-zçğıöşü]+", "")
    found = F.regexp_extract_all(low, F.lit(f"[{_LETTER}][{_LETTER}\\-]*[{_LETTER}]"), F.lit(0))
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))
    listed = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    told = lambda w: ~F.array_contains(listed, w)

    def both(words: Column) -> Column:
        single = F.transform(F.filter(words, told), lambda w: F.struct(plain_key(w).alias("key"), w.alias("word")))
        pair = F.transform(words, lambda w, i: F.when((i > 0) & told(w) & told(F.coalesce(F.get(words, i - 1), F.lit(""))), F.struct(F.concat(plain_key(F.get(words, i - 1)), F.lit(" "), plain_key(w)).alias("key"), F.concat(F.get(words, i - 1), F.lit(" "), w).alias("word"))))
        return F.concat(single, F.filter(pair, lambda p: p.isNotNull()))

    return once(kept, both)


def ranked_terms(notes: DataFrame, group: str, key: str, text: Column, stop: list[str]) -> DataFrame:
    """(group, key, word, raw, score, rank): the terms that may name each group, best first.

    A term counts once a note. It must be in at least a fifth of the group's notes (two, of groups over two), and none
    of its words in more than a tenth of all notes, unless nothing else is left. It scores its share of the group times
    the log of its rarity; a pair that scores nearly what its words do replaces them, and goes otherwise.
    """
    said = notes.select(group, key, F.explode(terms(text, stop)).alias("t")).select(group, key, F.col("t.key").alias("term"), F.col("t.word").alias("word"))
    docs = said.select(group, key, "term").distinct()
    n = notes.agg(F.count(F.lit(1)).alias("_n"))
    df = docs.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    size = notes.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    floor = F.when(F.col("_size") > 2, F.greatest(F.lit(2), F.ceil(F.col("_size") * FLOOR))).otherwise(1)
    counted = docs.groupBy(group, "term").agg(F.count(F.lit(1)).alias("_c")).join(size, group).where(F.col("_c") >= floor)
    parts = df.select(F.col("term").alias("_part"), F.col("_df").alias("_part_df"))
    worst = counted.select(group, "term", F.explode(F.split("term", " ")).alias("_part")).join(parts, "_part", "left").groupBy(group, "term").agg(F.max(F.coalesce("_part_df", F.lit(0))).alias("_worst"))
    met = counted.join(df, "term").join(worst, [group, "term"]).join(F.broadcast(n))
    rare = F.col("_worst") <= F.greatest(F.lit(3.0), F.col("_n") * COMMON)
    raw = F.col("_c") / F.col("_size") * F.log(F.col("_n") / F.col("_df"))
    own = Window.partitionBy(group)
    scored = met.withColumn("_rare", rare).withColumn("_any", F.max("_rare").over(own)).where(F.col("_rare") | ~F.col("_any")).select(group, "term", raw.alias("raw"))
    # a pair against its words
    pairs = scored.where(F.contains("term", F.lit(" ")))
    words = scored.where(~F.contains("term", F.lit(" ")))
    split = pairs.select(group, "term", F.col("raw").alias("_pair"), F.explode(F.split("term", " ")).alias("_word"))
    against = split.join(words.select(group, F.col("term").alias("_word"), F.col("raw").alias("_own")), [group, "_word"], "left")
    better = against.groupBy(group, "term").agg(F.min(F.col("_pair") >= F.coalesce("_own", F.lit(0.0)) * PAIR).alias("_wins")).where("_wins").select(group, "term")
    beaten = against.join(better, [group, "term"]).select(group, F.col("_word").alias("term")).distinct()
    left = words.join(beaten, [group, "term"], "left_anti").unionByName(pairs.join(better, [group, "term"]).select(*pairs.columns))
    surface = said.groupBy("term", "word").agg(F.count(F.lit(1)).alias("_k")).groupBy("term").agg(F.max_by("word", F.struct("_k", "word")).alias("word"))
    place = F.row_number().over(own.orderBy(F.desc("score"), F.asc("term")))
    return left.withColumn("score", F.round("raw", 8)).withColumn("rank", place).join(surface, "term").select(group, F.col("term").alias("key"), "word", "raw", "score", "rank")


def names(ranked: DataFrame, group: str) -> DataFrame:
    """(group, label): up to three of a group's ranked terms, none part of another, those after the first at least half as telling.

    Terms that can't be among the first twelve are never looked at.
    """
    listed = ranked.where("rank <= 12").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "key", "word", "score"))).alias("_l"))

    def step(acc: Column, t: Column) -> Column:
        known = F.exists(acc, lambda p: F.contains(p["key"], t["key"]) | F.contains(t["key"], p["key"]))
        weak = (F.size(acc) > 0) & (t["score"] < F.coalesce(F.get(acc, F.lit(0))["score"], F.lit(0.0)) * WEAK)
        return F.when(known | weak | (F.size(acc) >= WORDS), acc).otherwise(F.array_append(acc, t))

    kind = dict(listed.dtypes)["_l"]
    picked = F.aggregate("_l", F.array().cast(kind), step)
    label = F.array_join(F.transform(picked, lambda t: F.concat(F.upper(F.substring(t["word"], 1, 1)), F.substring(t["word"], F.lit(2), F.length(t["word"])))), " · ")
    return listed.select(group, label.alias("label"))
