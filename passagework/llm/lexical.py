"""Ranked lexical search, reversed: the items' inverted index is broadcast and every document's term counts stream through it.

Items are dealt in blocks of bounded size, and each block is a search of its own. Its index maps a term to the items
that hold it; a task reads documents, adds what each of their terms scores for the items of its list, and keeps a
heap of the best documents of each item. Only heaps are shuffled and merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.llm.arrays import bounds, lean
from passagework.llm.bpe import binaries
from passagework.llm.shared import settled, table

#: Items and bytes of item text of a block; scores held at a time; bytes of a text whose terms are held at a time.
BLOCK_ITEMS, BLOCK_BYTES, CELLS, PART_BYTES = 2000, 8_000_000, 1 << 20, 1 << 20
#: Stands for no doc_id while documents are ranked, so that these come last among equals.
NO_ID = (1 << 63) - 1

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

COUNTED = "doc_id bigint, n bigint, terms binary, times binary"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, letters A-Z in lower case: runs of letters, digits and all that isn't ASCII."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PART_BYTES and (gap := _GAP.search(text, at + PART_BYTES)):
            end = gap.start()
        yield _TERM.findall(text[at:end].lower())
        at = end


class Index(NamedTuple):
    """The items of a block and, for each of their terms, where its list begins in `item` and `times`."""

    items: list
    number: dict[bytes, int]
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray


def indexed(items: pa.Table) -> Index:
    """The inverted index of items (item_id, text)."""
    number: dict[bytes, int] = {}
    lists: list[list[tuple[int, int]]] = []
    for i, text in enumerate(items["text"].to_pylist()):
        counts: Counter = Counter()
        for found in term_lists((text or "").encode()):
            counts.update(found)
        for term, n in counts.items():
            if (t := number.setdefault(term, len(lists))) == len(lists):
                lists.append([])
            lists[t].append((i, n))
    flat = np.array([p for posted in lists for p in posted], np.int64).reshape(-1, 2)
    first = np.append(0, np.cumsum([len(p) for p in lists])).astype(np.int64)
    return Index(items["item_id"].to_pylist(), number, first, flat[:, 0].copy(), flat[:, 1].copy())


def counted(docs: DataFrame, number) -> DataFrame:
    """(doc_id, terms in all, numbers of the broadcast terms that it holds as 32-bit ints, how often as 64-bit ints) of every row with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            total, terms, times = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            sizes = np.zeros(len(texts) + 1, np.int64)
            for i in range(len(texts)):
                counts: Counter = Counter()
                for found in term_lists(texts[i].as_py() or b""):
                    total[i] += len(found)
                    counts.update(filter(known.__contains__, found))
                sizes[i + 1] = len(counts)
                terms.append(np.fromiter(map(known.__getitem__, counts), np.int32, len(counts)))
                times.append(np.fromiter(counts.values(), np.int64, len(counts)))
            at = np.cumsum(sizes)
            columns = [batch.column(0), pa.array(total), *(binaries(np.concatenate(x).view(np.uint8), at * size) for x, size in ((terms, 4), (times, 8)))]
            yield pa.record_batch(columns, ["doc_id", "n", "terms", "times"]).filter(pa.array(total > 0))

    return docs.select("doc_id", "text").mapInArrow(lean(run), COUNTED)


def document_frequencies(rows: DataFrame, terms: int) -> DataFrame:
    """(term, df) over the counted rows; each task hands on a number for each of the block's terms at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    return rows.select("terms").mapInArrow(lean(run), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """All numbers of a column of binaries, in order."""
    column = column.cast(pa.large_binary())
    at, data = bounds(column), column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)


class Heaps:
    """The best k documents of each item so far, by score, then by doc_id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(items, np.int64)  # what a document must reach to enter an item's full heap

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        begins = np.searchsorted(item, item)
        place = np.arange(len(item)) - begins
        self.least[item[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]


def _scored(index, weights, documents: int, terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weight = index.value, weights.value
        width = np.diff(found.first)
        heaps = Heaps(len(found.items), k)
        step = max(1, CELLS // max(1, len(found.items)))
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            damping = 25 + (75 * batch.column(1).to_numpy() * documents) // terms
            for row in range(0, batch.num_rows, step):
                part = batch.slice(row, step)
                term, times = _numbers(part.column(2), np.int32), _numbers(part.column(3), np.int64)
                doc = np.repeat(np.arange(len(part)), np.diff(bounds(part.column(2).cast(pa.large_binary()))) // 4)
                value = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * damping[row + doc]))
                scores = np.zeros((len(part), len(found.items)), np.int64)
                # the lists of all terms of all documents, a bounded number of entries at a time
                upto = np.cumsum(width[term])
                for a, b in _runs(upto, CELLS):
                    n = width[term[a:b]]
                    at = np.repeat(found.first[term[a:b]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    np.add.at(scores, (np.repeat(doc[a:b], n), found.item[at]), np.repeat(value[a:b], n) * found.times[at])
                here, item = np.nonzero((scores > 0) & (scores >= heaps.least))
                heaps.add(item, ids[row + here], scores[here, item])
        names = pa.array([found.items[i] for i in heaps.item], pa.int64())
        # the partition's number deals the heaps of one item to several first mergers
        at = pa.array(np.full(len(heaps.item), TaskContext.get().partitionId(), np.int64))
        yield pa.record_batch([pa.array(heaps.item), names, pa.array(heaps.doc), pa.array(heaps.score), at], ["item", "item_id", "doc_id", "score", "task"])

    return run


def _runs(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places that together have at most so many entries, or one place."""
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _best(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    spark = docs.sparkSession
    index = indexed(items)
    rows = settled(counted(docs, spark.sparkContext.broadcast(index.number)))
    documents, terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = document_frequencies(rows, len(index.number)).withColumn("w", F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))).toPandas()
    weight = np.zeros(len(index.number), np.int64)
    weight[found["term"].to_numpy("int64")] = found["w"].to_numpy("int64")
    share = spark.sparkContext.broadcast
    scored = rows.mapInArrow(lean(_scored(share(index), share(weight), documents, terms or 1, k)), "item bigint, item_id bigint, doc_id bigint, score bigint, task bigint")
    merged = _best(scored.withColumn("task", F.pmod("task", F.lit(64))), k, "item", "task").drop("rank")
    best = _best(merged, k, "item")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its k best of all rows of docs (doc_id, text) with a score above 0.

    Scores are whole numbers: the sum over the item's terms, repeats included, of floor(1000 ln((2 N + 2) / (2 df + 1)))
    times tf, damped by the document's length. Equal scores rank by doc_id, rows without one last (and those of the
    largest long). Every row with a term counts in N, df and lengths, repeated rows too, and is ranked; null and empty
    texts have no terms. Every row of items is ranked by itself, so repeated items repeat their answer; items without
    terms or without hits have none. Empty tables give no rows; further columns are ignored.
    """
    known = items.select("item_id", "text")
    n, size = known.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    dealt = known if blocks == 1 else settled(known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    found = None
    for block in range(blocks):
        own = dealt if blocks == 1 else dealt.where(F.col("block") == block)
        part = _block(docs, own.select("item_id", "text").toArrow(), k)
        found = part if found is None else found.unionByName(part)
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with term_of as materialized (
  select doc_id, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select doc_id, text, row_number() over () as doc from documents)
), sizes as (
  select doc, count(*) as n from term_of group by doc
), totals as (
  select count(*)::bigint as nd, sum(n)::bigint as l from sizes
), wanted as materialized (
  select item_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select item_id, text, row_number() over () as item from benchmark)
), repeats as (
  select item_id, item, term, count(*) as times from wanted group by item_id, item, term
), tfs as (
  select doc_id, doc, term, count(*) as tf from term_of where term in (select term from wanted) group by doc_id, doc, term
), weights as (
  select term, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tfs group by term), totals
), scored as (
  select item_id, item, doc_id, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nd) // l)))))::bigint as score
  from repeats join tfs using (term) join weights using (term) join sizes using (doc), totals
  group by item_id, item, doc_id, doc
), ranked as (
  select item_id, row_number() over (partition by item order by score desc, doc_id)::integer as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
