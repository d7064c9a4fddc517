"""Quality rules: text statistics, and a decision list learned from labelled ones. DataFrame functions only.

Sequential covering: a conjunction of thresholds is grown on one part of the labelled rows, pruned on the other,
its rows are taken away, and the next follows; the list becomes an ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.shared import one_text_each, settled, table

#: Labelled rows that rules are learned from at most, chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
#: Thresholds tried for each statistic, at equal ranks among good and among junk rows; rules, conditions of a rule; least precision on pruning rows.
CUTS, MOST_RULES, MOST_CONDITIONS, PRECISION = 32, 8, 3, 0.95
#: Documents of fewer words, or with more than this percentage of words in repeated windows, fail the base.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE = r"[\x20\x09-\x0D]"
STATISTICS = ("words", "word_length", "symbols", "capitals", "marks", "repeated_lines", "repeated_words", "distinct_words")


def statistics(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the shares in STATISTICS) of every text.

    `row` holds all columns of docs. Null and empty texts have no words, and 0 everywhere. A text is measured in its
    own row, so a long one costs its task n log n and nobody else anything.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    base = docs.select(F.struct("*").alias("row")).select("row", F.array_remove(F.split(text, _SPACE + "+", -1), "").alias("w"))
    lines = base.select("*", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    left = F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0)))
    windows = F.transform(left, lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    ordered = lines.select(
        "row", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), F.size(F.array_distinct("w")).alias("n_distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.sort_array(windows).alias("s"),
    )
    # windows of one 64-bit hash are neighbours now; a window is repeated if its hash equals that before or after it
    rest = F.greatest(F.size("s") - 1, F.lit(0))
    same = F.zip_with(
        F.slice("s", 1, rest), F.slice("s", 2, rest),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])),
    )
    repeated = F.sort_array(F.flatten(F.array_compact(same)))

    def cover(acc: Column, i: Column) -> Column:
        return F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end"))

    covered = F.aggregate("r", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda acc: acc["n"])
    found = ordered.select("*", repeated.alias("r")).select("*", F.when(F.size("r") > 0, covered).otherwise(0).alias("n_repeat_words"))
    count = lambda outside: F.length(F.regexp_replace(text, outside, ""))
    measured = found.select("row", "n_words", "word_chars", "n_distinct", "n_dup_lines", "n_repeat_words", count(r"[^#*$%&|<>]+").alias("n_symbols"), count("[^A-Z]+").alias("n_capitals"), count("[^!?]+").alias("n_marks"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    # a filter on these columns would be pushed below the projections above and repeat them; it stays above inline()
    return measured.select("row", F.inline(F.array(F.struct(
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("n_words").cast("double").alias("words"), share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbols"),
        share("n_capitals", "word_chars").alias("capitals"), share("n_marks", "n_words").alias("marks"), F.col("n_dup_lines").cast("double").alias("repeated_lines"),
        share("n_repeat_words", "n_words").alias("repeated_words"), share("n_distinct", "n_words").alias("distinct_words"),
    ))))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.holds() for c in rule], F.lit(True))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the condition of largest FOIL gain until no junk-free improvement is left; one small aggregate a step.

    What reaches the driver is a count for each statistic and threshold.
    """
    rule: Rule = ()
    place = F.expr("stack({}, {}) as (statistic, bin)".format(len(cuts), ", ".join(f"'{s}', bin_{s}" for s in cuts)))
    while len(rule) < MOST_CONDITIONS:
        counted = rows.where(_all(rule)).select("junk", place).groupBy("statistic", "bin").agg(F.sum("junk").alias("p"), F.sum(1 - F.col("junk")).alias("n")).collect()
        bins: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted:
            bins.setdefault(r["statistic"], {})[r["bin"]] = (r["p"], r["n"])
        if not bins:
            break
        one = next(iter(bins.values())).values()
        p0, n0 = sum(p for p, _ in one), sum(n for _, n in one)
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for s in sorted(bins):
            p = n = 0
            for b, cut in enumerate(cuts[s]):
                p, n = p + bins[s].get(b, (0, 0))[0], n + bins[s].get(b, (0, 0))[1]
                for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    g = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0))) if pp else 0.0
                    if g > gain + 1e-9:
                        best, gain = Condition(s, above, cut), g
        if best is None:
            break
        # the threshold goes to the middle of the gap between the rows on its two sides
        value = F.col(best.statistic)
        gap = rows.where(_all(rule)).agg(F.max(F.when(value <= best.threshold, value)).alias("low"), F.min(F.when(value > best.threshold, value)).alias("high")).first()
        if gap["low"] is not None and gap["high"] is not None:
            best = Condition(best.statistic, best.above, (gap["low"] + gap["high"]) / 2)
        rule += (best,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The rule's beginning that separates the pruning rows best, with the junk and good rows it covers."""
    ends = range(1, len(rule) + 1)
    sums = [F.sum(F.when(_all(rule[:k]), v).otherwise(0)).alias(f"{name}{k}") for k in ends for name, v in (("p", F.col("junk")), ("n", 1 - F.col("junk")))]
    got = rows.agg(*sums).first()
    value = lambda k: ((got[f"p{k}"] or 0) - (got[f"n{k}"] or 0)) / max((got[f"p{k}"] or 0) + (got[f"n{k}"] or 0), 1)
    k = max(ends, key=lambda k: (value(k), -k))
    return rule[:k], got[f"p{k}"] or 0, got[f"n{k}"] or 0


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """The cuts that are tried for each statistic: values at equal ranks among the good rows and among the junk."""
    ranks = [(k + 1) / CUTS for k in range(CUTS - 1)]
    of = [F.percentile_approx(F.when(F.col("junk") == y, F.col(s)), ranks, 10_000).alias(f"{s}_{y}") for s in STATISTICS for y in (0, 1)]
    got = labelled.agg(*of).first()
    return {s: sorted({*(got[f"{s}_0"] or []), *(got[f"{s}_1"] or [])}) for s in STATISTICS}


def for_pruning() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0


def learn(labelled: DataFrame) -> list[Rule]:
    """The decision list for a settled table of the STATISTICS and junk (1 or 0), at most TRAINING_ROWS rows.

    Ties between conditions go to the first statistic and the lowest threshold, so equal rows give equal rules.
    """
    cuts = thresholds(labelled)
    if not any(cuts.values()):
        return []
    bins = [F.size(F.filter(F.array(*map(F.lit, c)), _below(s))).alias(f"bin_{s}") for s, c in cuts.items()]
    rows = settled(labelled.select("junk", *STATISTICS, *bins, for_pruning().alias("for_pruning")))
    rules: list[Rule] = []
    left = rows
    while len(rules) < MOST_RULES:
        grown = _grow(left.where("not for_pruning"), cuts)
        if not grown:
            break
        rule, p, n = _prune(left.where("for_pruning"), grown)
        if p < 3 or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def _below(statistic: str):
    return lambda cut: cut < F.col(statistic)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the first rule that holds rejects, else the document is kept."""
    cases = F.when(base_failed(), False)
    for rule in rules:
        cases = cases.when(_all(rule), False)
    return cases.otherwise(True)


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, junk and STATISTICS of at most TRAINING_ROWS labelled documents, one row an id; rows that fail the base teach nothing."""
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    found = statistics(one_text_each(docs, usable))
    return settled(found.where(~base_failed()).select("row.doc_id", (F.col("row.quality") == 0).cast("int").alias("junk"), *STATISTICS))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every row of docs with base_failed and kept, by rules learned from its labelled rows.

    Without labels the list is empty and the base alone decides. Repeated rows are judged each, alike; null and empty
    texts fail the base; the columns of docs stay in `row`, so none clashes; an empty table gives no rows.
    """
    rules = learn(labelled_statistics(docs, labels))
    return statistics(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that the rules reject.

    Null and empty texts fail the base and go; repeated rows stay or go alike; an empty table stays empty.
    """
    return judged(docs, labels).where("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
