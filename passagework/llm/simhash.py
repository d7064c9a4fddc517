"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints that share a variant are within
the radius, and two within the radius share one halfway between them, so a collision is a link and none is missed.
Variants are shuffled by their first bits: those of one fingerprint that go the same way travel as one row and are
written out where they arrive. What a bucket hands on is a forest of its links, never the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import SLICE_BYTES, lean, slices, words
from passagework.llm.graph import components
from passagework.llm.shared import attach, settled, table

SEED = 42
#: Variants that a bucket gets on average at most, and those that are held at a time: a larger bucket is dealt in slices.
BUCKET_VARIANTS, SLICE_VARIANTS = 1 << 18, 1 << 21


def shingle_hashes(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle of all texts, where each text's begin), letters A-Z in lower case, words joined by a blank."""
    w = words(texts, lower=True)
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - size - 1
    # the words of all texts with one blank after each
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[np.repeat(w.starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    count = np.diff(w.first)
    shingles = np.where(count > 0, np.maximum(1, count - n_words + 1), 0)
    first = np.append(0, np.cumsum(shingles))
    at = np.repeat(w.first[:-1] - first[:-1], shingles) + np.arange(first[-1])
    last = at + np.repeat(np.minimum(n_words, count), shingles) - 1
    data, h = joined.tobytes(), xxhash.xxh64_intdigest
    values = np.fromiter((h(data[a:b], SEED) for a, b in zip(begin[at].tolist(), (begin + size)[last].tolist(), strict=True)), np.uint64, len(at))
    return values, first


def majority(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each set of hashes the bits that are set in over half of them; zero for none."""
    full, out = np.flatnonzero(np.diff(first)), np.zeros(len(first) - 1, np.uint64)
    if len(full):
        n, begins = np.diff(first)[full], first[:-1][full]
        for bit in range(64):
            ones = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), begins, dtype=np.int64)
            out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(batch.column(1), SLICE_BYTES // 2):
                marks = majority(*shingle_hashes(part, n_words))
                yield pa.record_batch([batch.column(0).slice(row, len(part)), pa.array(marks.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, fingerprint bigint")


@lru_cache(8)
def flips(bits: int, most: int) -> np.ndarray:
    """All masks of so many low bits with at most `most` ones."""
    return np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)], np.uint64)


def variants(marks: np.ndarray, bucket: int, depth: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in marks, variant) of the variants of marks whose first `depth` bits are the bucket, some at a time."""
    low = 64 - depth
    head = np.uint64(bucket) << np.uint64(low)
    changed = np.bitwise_count((marks >> np.uint64(low)) ^ np.uint64(bucket))
    for d in range(min(half, depth) + 1):
        masks, rows = flips(low, half - d), np.flatnonzero(changed == d)
        tails = head | (marks[rows] & np.uint64((1 << low) - 1))
        step = max(1, SLICE_VARIANTS // 4 // len(masks))
        for i in range(0, len(rows), step):
            yield np.repeat(rows[i : i + step], len(masks)), (tails[i : i + step, None] ^ masks).ravel()


def forest(marks: np.ndarray, owner: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint that its collisions lead to here) of the marks that share a variant."""
    every = np.sort(value)
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(shared):
        return marks[:0], marks[:0]
    at = np.searchsorted(shared, value)
    met = shared[np.minimum(at, len(shared) - 1)] == value
    owner, at = owner[met], at[met]
    order = np.lexsort((marks[owner], at))
    owner, at = owner[order], at[order]
    begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    leader = np.repeat(owner[begins], np.diff(np.append(begins, len(at))))
    close = np.bitwise_count(marks[owner] ^ marks[leader]) <= radius
    pairs = np.unique(np.stack([owner[close], leader[close]], axis=1), axis=0)
    a, b = pairs[:, 0], pairs[:, 1]
    root = marks.copy()
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if (root == before).all():
            break
    linked = np.flatnonzero(root != marks)
    return marks[linked], root[linked]


def _met(depth: int, radius: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        marks = np.unique(table["fingerprint"].to_numpy().view(np.uint64))
        bucket, part, parts = (table[c][0].as_py() for c in ("bucket", "slice", "slices"))
        links: list[tuple[np.ndarray, np.ndarray]] = []
        if len(marks) > 1:
            owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for owner, value in variants(marks, bucket, depth, radius // 2):
                if parts > 1:
                    own = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts) == part
                    owner, value = owner[own], value[own]
                owners.append(owner)
                values.append(value)
            links.append(forest(marks, np.concatenate(owners), np.concatenate(values), radius))
        a, b = (np.concatenate([np.zeros(0, np.uint64), *(x[k] for x in links)]).view(np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def links(marks: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect all fingerprints of the settled table marks (fingerprint, distinct) as those within the radius do."""
    half = radius // 2
    total = sum(math.comb(64, k) for k in range(half + 1))
    depth = min(32, max(4, math.ceil(math.log2(max(1, marks.count() * total / BUCKET_VARIANTS)))))
    near = F.array(*(F.lit(int(m)) for m in flips(depth, half)))
    head = F.shiftrightunsigned("fingerprint", 64 - depth)
    sent = marks.select("fingerprint", F.explode(near).alias("flip")).select("fingerprint", head.bitwiseXOR(F.col("flip").cast("long")).alias("bucket"), F.bit_count("flip").alias("changed"))
    # a fingerprint whose first bits differ in d has variants for the other half - d
    held = F.element_at(F.array(*(F.lit(len(flips(64 - depth, half - d))) for d in range(half + 1))), F.col("changed") + 1)
    wide = sent.groupBy("bucket").agg(F.ceil(F.sum(held.cast("long")) / SLICE_VARIANTS).cast("int").alias("slices"), F.count(F.lit(1)).alias("n")).where("slices > 1")
    dealt = attach(sent.drop("changed"), settled(wide), "bucket", "n").select("fingerprint", "bucket", F.coalesce("slices", F.lit(1)).alias("slices"))
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return dealt.groupBy("bucket", "slice").applyInArrow(_met(depth, radius), "a bigint, b bigint").distinct()


def simhash_near_dedup(docs: DataFrame, n_words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) for every row of docs (doc_id, text).

    Rows whose fingerprints differ in at most `radius` bits (an even number) are linked; component_id is the smallest
    doc_id that links reach. Null texts, empty ones and those without words have fingerprint zero and are linked like any
    other; a text of fewer than n_words words is one shingle. Equal fingerprints are one node, however many rows have
    it. Repeated rows are answered each, also those of one doc_id with different texts; a row without a doc_id gets the
    component of its links, null where no row of it has a doc_id. An empty table gives no rows; further columns are ignored.
    """
    if radius % 2:
        raise ValueError("the radius must be even: collisions within half of it are links then")
    rows = settled(fingerprints(docs, n_words))
    classes = settled(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    parts = components(links(classes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = settled(classes.join(parts, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")))
    least = settled(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of")))
    known = settled(attach(named.drop("least"), least, "component", "of").select("fingerprint", "n", "component_id"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return attach(rows, known, "fingerprint", "n").select("doc_id", digits.alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
