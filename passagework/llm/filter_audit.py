"""Filter interaction audit by forward-backward path counting over the lattice of filter subsets.

A run of all filters in some order is a path from the empty set to the full one. For every state the orders that reach
it and those that leave it are counted along the edges; an edge removes the documents that pass its lower state and fail
its filter. An edge's removals weighted by the orders through it give the Shapley sums, and the same edges give every
order's steps. Documents only enter as counts of their failure masks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import lean
from passagework.llm.shared import attach, settled, table

FILTERS = "ABCDE"
CAPITALS, SIGNS, CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: Bytes of a text whose words are held at a time.
PART_BYTES = 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through the edge) of every edge of the subset lattice of n filters, states as bit masks."""
    full = (1 << n) - 1
    reaching, leaving = [1] + [0] * full, [0] * full + [1]
    for state in range(full + 1):
        for i in range(n):
            if not state >> i & 1:
                reaching[state | 1 << i] += reaching[state]
    for state in range(full, -1, -1):
        for i in range(n):
            if state >> i & 1:
                leaving[state & ~(1 << i)] += leaving[state]
    return [(s, i, reaching[s] * leaving[s | 1 << i]) for s in range(full + 1) for i in range(n) if not s >> i & 1]


def failed(text: bytes) -> int:
    """The bits of the filters A to D that a text fails; words are split in parts, so that no list holds all words of a long text."""
    n, kinds, at = 0, set(), 0
    while at < len(text):
        end = len(text)
        if end - at > PART_BYTES and (gap := _GAP.search(text, at + PART_BYTES)):
            end = gap.start()
        found = text[at:end].split()  # bytes are split at the six blanks of ASCII only
        n += len(found)
        kinds.update(found)
        at = end
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    signs = len(text) - len(text.translate(None, SIGNS))
    return (n < 50) | (100 * len(kinds) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (signs > 0) << 3


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (x.as_py() or b"" for x in batch.column(2).cast(pa.large_binary()))
        found = [(failed(text), hashlib.sha256(text).digest()) for text in texts]
        yield pa.record_batch([*batch.columns[:2], pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every row: the bits of the filters A to D that its text fails, and the text's SHA-256."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(lean(_failures), "doc_id bigint, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many rows of a part fail just the filters of a mask, and how many of those are labelled so."""
    rows = settled(failures(docs))
    repeated = settled(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    marked = attach(rows, repeated, "digest", "n").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = marked.join(labelled, "doc_id", "left")
    return met.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def edges(counts: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, kept, removed, redundant, good_lost, toxic_lost, unique_fails, shapley) of every edge of every part's lattice."""
    steps = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter"), F.lit(orders).alias("orders")) for s, i, orders in lattice(n)))
    bit = F.expr("shiftright(mask, filter) & 1 = 1")
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda column, when: F.sum(F.when(when, F.col(column)).otherwise(0))
    found = counts.select("*", F.inline(steps)).groupBy("part", "state", "filter", "orders").agg(
        total("docs", passed & ~bit).alias("kept"), total("docs", passed & bit).alias("removed"), total("docs", ~passed & bit).alias("redundant"),
        total("good", passed & bit).alias("good_lost"), total("toxic", passed & bit).alias("toxic_lost"),
        total("docs", F.col("mask") == F.expr("shiftleft(1, filter)")).alias("unique_fails"),
    )
    sums = found.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    return found.drop("orders").join(sums, ["part", "filter"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (source; null: empty string), order of the five filters and step, zeros included.

    docs has doc_id, text and source; labels has doc_id, quality and toxic. Filters: A fewer than 50 words; B under 65
    distinct words in 100; C over 5 capitals A-Z in 100 code points; D holds any of #$%&*|; E identical to the text of
    any smaller doc_id of the table. Counts are of rows: repeated rows count each, and neither is a copy of the other
    unless its doc_id is larger. A row without a doc_id is no copy, makes none, and has no label. Null text is empty. A
    doc_id with several labels has quality or toxic 1 if any label says so. Empty docs give no rows; without labels nothing is
    lost; further columns are ignored.
    """
    walked = settled(edges(settled(masks(docs, labels)), len(FILTERS)))
    orders = [
        ("".join(FILTERS[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in permutations(range(len(FILTERS))) for step in range(len(FILTERS))
    ]
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, state int, filter int")
    return walked.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), failing as (
  select doc_id, part,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) over (partition by text), false)] as f
  from words
), labelled as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
), counted as (
  select part, f, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from failing left join labelled using (doc_id) group by part, f
), filters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 3, 4, 5]) as i
), orders as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.i, b.i, c.i, d.i, e.i] as o
  from filters a, filters b, filters c, filters d, filters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (
  select filter_order, step, o[step] as i, list_slice(o, 1, step - 1) as earlier from orders, (select unnest([1, 2, 3, 4, 5]) as step)
), told as (
  select part, filter_order, step, i, n, good, toxic, f[i] as fails,
    len(list_filter(earlier, lambda k: f[k])) > 0 as gone, len(list_filter(f, lambda x: x)) = 1 as single
  from counted, steps
), summed as (
  select part, filter_order, step::integer as step, i,
    sum(case when not gone and not fails then n else 0 end) as kept,
    sum(case when not gone and fails then n else 0 end) as removed,
    sum(case when gone and fails then n else 0 end) as redundant,
    sum(case when fails and single then n else 0 end) as unique_fails,
    sum(case when not gone and fails then good else 0 end) as good_lost,
    sum(case when not gone and fails then toxic else 0 end) as toxic_lost
  from told group by part, filter_order, step, i
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, i))::bigint as shapley
from summed
"""
