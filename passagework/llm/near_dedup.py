"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with one shingle set form a class. Classes are posted under their rarest coordinate values only (prefix);
the longer lists are skipped and probed through the signatures when collisions are counted. Pairs above the match
threshold are confirmed on the full sets. Each list is linked to a center first; other pairs are tried only between the
components that the centers leave apart, so the copies that a center has gathered make no pairs among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import SLICE_BYTES, lean, mixed, owners, slices, span_hashes, words
from passagework.llm.graph import components
from passagework.llm.shared import BROADCAST_ROWS, attach, one_each, own_ids, settled, table, text_digest, without

#: Coordinates of a signature and how many must collide. At a similarity of 0.8 a pair has 51 on average, and fewer
#: than 34 in 3 of 10 million cases. A pair with that many shares one of its 31 first coordinates in any fixed order.
COORDINATES, MATCHES = 64, 34
PREFIX = COORDINATES - MATCHES + 1
#: Of the two bits kept of each coordinate, how many must agree before signatures are fetched. At a similarity of 0.8 a
#: pair with enough collisions has fewer in 1.1 of 10 million cases, less than what the collisions lose.
BITS = 90
#: Least similarity in percent, on the full sets.
SIMILAR = 80
#: Sets of so few shingles are similar to equal sets only.
ALONE = 3
#: Clusters of so many classes are tried pair by pair, larger ones in blocks of BLOCK by BLOCK; lists in blocks of LIST_BLOCK.
SMALL, BLOCK, LIST_BLOCK = 24, 256, 2048
#: Buckets in which coordinate values are counted, to tell common from rare ones.
BUCKETS = 1 << 18

_random = np.random.default_rng(20_240_601)
_FACTOR = _random.integers(0, 1 << 62, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 62, COORDINATES, np.uint64)


def shingle_sets(texts: pa.Array, n_words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, where each text's begin), letters A-Z in lower case.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    w = words(texts, lower=True)
    word, text, count = span_hashes(w.data, w.starts, w.ends), owners(w.first), np.diff(w.first)
    place = np.arange(len(word)) - w.first[text] if len(word) else np.zeros(0, np.int64)
    size = np.minimum(n_words, count[text]) if len(word) else np.zeros(0, np.int64)
    begins = np.flatnonzero(place + size <= count[text])
    value = np.zeros(len(begins), np.uint64)
    for k in range(n_words):
        inside = k < size[begins]
        value[inside] = mixed(value[inside] * np.uint64(0x9FB21C651E98DF25) + word[begins[inside] + k] + np.uint64(k + 1))
    text = text[begins]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least of each hash function over every set, 32 bits each; zeros for empty sets."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, COORDINATES), np.uint32)
    if len(full):
        for k in range(COORDINATES):
            hashed = ((values * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(hashed, first[:-1][full])
    return out


def _signed(n_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(batch.column(1), SLICE_BYTES // 2):
                values, first = shingle_sets(part, n_words)
                marks, at = signatures(values, first), first.tolist()
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch(
                    [batch.column(0).slice(row, len(part)), pa.array(np.diff(first)), pa.array(digests, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    return run


def signed(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature) of every row."""
    return docs.select("doc_id", "text").mapInArrow(lean(_signed(n_words)), "doc_id bigint, n_shingles bigint, digest binary, signature binary")


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _keys(marks: np.ndarray) -> np.ndarray:
    return mixed(marks.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def value_counts(classes: DataFrame) -> np.ndarray:
    """How many classes have a coordinate value, by bucket of its hash; the table's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount((_keys(_marks(batch.column(0))) % np.uint64(BUCKETS)).astype(np.int64).ravel(), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = classes.select("signature").mapInArrow(lean(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[found["bucket"].to_numpy("int64")] = found["n"].to_numpy("int64")
    return total


def postings(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, rep, common, b0, b1): each class under its PREFIX rarest coordinate values.

    Rarity is the count in the value's bucket, then the value's hash: one order for all classes, as the prefix asks.
    `common` says how common all its values are together; b0 and b1 hold two bits of each coordinate.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _marks(batch.column(1))
            keys = _keys(marks)
            n = shared.value[(keys % np.uint64(BUCKETS)).astype(np.int64)]
            order = np.lexsort((keys, n), axis=1)[:, :PREFIX]
            bits = [np.packbits((marks >> np.uint32(s)) & np.uint32(1) == 1, axis=1).view("<i8").ravel() for s in (3, 17)]
            each = lambda x: pa.array(np.repeat(x, PREFIX))
            yield pa.record_batch(
                [pa.array(np.take_along_axis(keys, order, axis=1).astype(np.int64).ravel()), each(batch.column(0).to_numpy()), each(n.sum(axis=1)), each(bits[0]), each(bits[1])],
                ["key", "rep", "common", "b0", "b1"],
            )

    return classes.select("rep", "signature").mapInArrow(lean(run), "key bigint, rep bigint, common bigint, b0 bigint, b1 bigint")


def _alike(a: str, b: str):
    agree = 2 * COORDINATES - F.bit_count(F.col(f"{a}b0").bitwiseXOR(F.col(f"{b}b0"))) - F.bit_count(F.col(f"{a}b1").bitwiseXOR(F.col(f"{b}b1")))
    return agree >= BITS


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        enough = (_marks(batch.column(2)) == _marks(batch.column(3))).sum(axis=1) >= MATCHES
        yield batch.select([0, 1]).filter(pa.array(enough))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            both = len(np.intersect1d(a, b, assume_unique=True))
            kept.append(100 * both >= SIMILAR * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def _sets(n_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(batch.column(1), SLICE_BYTES // 2):
                values, first = shingle_sets(part, n_words)
                at = first.tolist()
                yield pa.record_batch([batch.column(0).slice(row, len(part)), pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["rep", "shingles"])

    return run


def colliding(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The settled pairs (a, b) with at least MATCHES equal coordinates, settled."""
    marks = classes.select("rep", "signature")
    both = pairs.join(marks.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(marks.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    return settled(both.select("a", "b", "sa", "sb").mapInArrow(lean(_colliding), "a bigint, b bigint"))


def _full_sets(ids: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """(rep, shingles) of the documents in ids (doc_id), settled; ids are broadcast only if few, by count."""
    asked = settled(ids.distinct())
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(asked) if few else asked, "doc_id").select("doc_id", "text")
    return settled(texts.mapInArrow(lean(_sets(n_words)), "rep bigint, shingles binary"))


def confirmed(pairs: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """(a, b) of the settled pairs that are similar on their full sets, settled."""
    sets = _full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, n_words)
    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
    return settled(full.select("a", "b", "xa", "xb").mapInArrow(lean(_confirmed), "a bigint, b bigint").distinct())


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): each class of a list with the list's center, where their bits agree."""
    found = shared.where(F.col("rep") != F.col("c_rep")).where(_alike("", "c_"))
    return found.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")).distinct()


def _compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of one cluster, of different components: collisions as matrices, then the full sets."""
    links: tuple[list, list] = ([], [])
    if len(left) and len(right):
        y, ys, yc = np.frombuffer(b"".join(right["r_signature"]), np.uint32).reshape(-1, COORDINATES), right["r_rep"].to_numpy(), right["r_component"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in right["r_shingles"]]
        for rep, part, mark, own in zip(left["rep"], left["component"], left["signature"], left["shingles"], strict=True):
            close = (y == np.frombuffer(mark, np.uint32)).sum(axis=1) >= MATCHES
            mine = np.frombuffer(own, np.uint64)
            for j in np.flatnonzero(close & (yc != part)):
                if 100 * min(len(mine), len(sets[j])) >= SIMILAR * max(len(mine), len(sets[j])):
                    both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                    if 100 * both >= SIMILAR * (len(mine) + len(sets[j]) - both):
                        links[0].append(min(rep, ys[j]))
                        links[1].append(max(rep, ys[j]))
    return pd.DataFrame({"a": pd.Series(links[0], dtype="int64"), "b": pd.Series(links[1], dtype="int64")})


def _within(members: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int) -> tuple[DataFrame, DataFrame]:
    """(untested pairs of small clusters, links of large ones) between the components of each cluster.

    members has rep, cluster and component. In a large cluster everything outside its largest component meets the
    whole cluster in blocks of BLOCK classes; a block pair hands on its links only.
    """
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest")).where("n > largest")
    split = settled(attach(members, settled(sizes), "cluster", "n").where("main is not null"))
    small = split.where(F.col("n") <= SMALL)
    x, y = (small.select("cluster", F.col("rep").alias(f"{c}_rep"), F.col("component").alias(f"{c}_component")) for c in "xy")
    pairs = x.join(y, "cluster").where("x_rep < y_rep and x_component <> y_component").select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
    large = split.where(F.col("n") > SMALL).join(classes.select("rep", "signature"), "rep")
    large = large.join(_full_sets(large.select(F.col("rep").alias("doc_id")), docs, n_words), "rep")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    n_left, n_right = blocks(F.col("n") - F.col("largest")), blocks(F.col("n"))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ("cluster", "rep", "component", "signature", "shingles")
    left = large.where("component <> main").select(*columns, own(n_left).alias("i"), every(n_right).alias("j"))
    right = large.select(*(F.col(c).alias(f"r_{c}") for c in columns), own(n_right).alias("r_j"), every(n_left).alias("r_i"))
    links = left.groupBy("cluster", "i", "j").cogroup(right.groupBy("r_cluster", "r_i", "r_j")).applyInPandas(_compared, "a bigint, b bigint")
    return pairs, links.distinct()


def _across(own: DataFrame) -> DataFrame:
    """(a, b): classes of one list that are in different clusters and whose bits agree.

    Of two such classes one is outside the list's largest cluster, so a list of one large cluster makes no pairs. A long
    list is compared in blocks of LIST_BLOCK by LIST_BLOCK, each a group of its own.
    """
    parts = own.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n"))
    major = parts.groupBy("key").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    rest = settled(attach(own, settled(major.select("key", "major", "n")), "key", "n").where("major is not null").withColumn("blocks", F.ceil(F.col("n") / LIST_BLOCK).cast("int")))
    own_block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    short, long = rest.where("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}), rest.where("blocks > 1")
    found = []
    for left, right in ((short, short), (long.withColumn("i", own_block).withColumn("j", every_block), long.withColumn("j", own_block).withColumn("i", every_block))):
        x, y = (side.select(*(F.col(c).alias(f"{name}_{c}") for c in side.columns)) for name, side in (("x", left), ("y", right)))
        once = (F.col("y_cluster") == F.col("y_major")) | (F.col("x_rep") < F.col("y_rep"))
        block = (F.col("x_key") == F.col("y_key")) & (F.col("x_i") == F.col("y_i")) & (F.col("x_j") == F.col("y_j"))
        met = x.where("x_cluster <> x_major").join(y, block & (F.col("x_cluster") != F.col("y_cluster")) & once & _alike("x_", "y_"))
        found.append(met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def linked(classes: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """(node, component) of the classes that are linked with another one.

    Classes that collide often enough with a list's center form a cluster with it. Links are sought between centers
    and their lists, then between the components that this leaves in a cluster, then between clusters.
    """
    spread = classes.where(F.col("n_shingles") > ALONE)
    posted = settled(postings(spread, value_counts(spread)))
    # the center of a list is the class whose values are most common in all: the likely origin of a group of near copies
    center = F.max(F.struct("common", (-F.col("rep")).alias("order"), "rep", "b0", "b1")).alias("c")
    lists = posted.groupBy("key").agg(center, F.count(F.lit(1)).alias("n")).where("n > 1")
    centers = settled(lists.select("key", "n", F.col("c.rep").alias("c_rep"), F.col("c.b0").alias("c_b0"), F.col("c.b1").alias("c_b1")))
    shared = settled(attach(posted, centers, "key", "n").where("c_rep is not null").drop("n"))
    near = colliding(settled(_stars(shared)), classes)
    found = confirmed(near, docs, n_words)
    clusters = settled(components(near).withColumnRenamed("component", "cluster"))
    parts = components(found)
    members = clusters.join(parts, "node", "left").select(F.col("node").alias("rep"), "cluster", F.coalesce("component", "node").alias("component"))
    pairs, links = _within(settled(members), classes, docs, n_words)
    own = settled(shared.select("key", "rep", "b0", "b1").join(clusters.withColumnRenamed("node", "rep"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep")))
    others = confirmed(colliding(settled(pairs.unionByName(_across(own)).distinct().join(near, ["a", "b"], "left_anti")), classes), docs, n_words)
    return settled(components(found.unionByName(settled(links)).unionByName(others)))


def near_dedup(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Rows are linked if 100 * intersection >= 80 * union of their sets of n_words-word shingles; component_id is the
    smallest doc_id that links reach, and only that row is kept. Null and empty texts have no shingles and no links;
    equal sets are one class; repeated rows of one doc_id are one document; rows without a doc_id take their class's
    component and are kept only if it has none. An empty table gives no rows; further columns are ignored.
    """
    marks = settled(signed(docs, n_words))
    full = marks.where("n_shingles > 0")
    counted = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = settled(counted)
    known = classes.where("rep is not null")
    parts = linked(known, docs, n_words)
    named = settled(classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id")))
    rows = attach(full.select("doc_id", "n_shingles", "digest"), named, "digest", "n").select("doc_id", "n_shingles", "component_id")
    alone = marks.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """docs, all columns, with one row of each component left, and every row without a doc_id or without words.

    The row of the smallest doc_id stays. Rows of one doc_id and different texts are decided each: they get numbers in
    the order of doc_id and text, and only the numbers are linked.
    """
    if not own_ids(docs):
        text = docs.where("doc_id is not null").select("doc_id", text_digest().alias("digest")).distinct()
        numbers = settled(text.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("_number", F.monotonically_increasing_id()))
        numbered = settled(docs.select("doc_id", "text", text_digest().alias("digest")).join(numbers, ["doc_id", "digest"], "left").select(F.col("_number").alias("doc_id"), "text"))
        dropped = near_dedup(numbered, n_words).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_number")).distinct().withColumn("_gone", F.lit(True))
        worded = settled(signed(numbered, n_words).where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("_number")))
        decided = worded.join(dropped, "_number", "left").join(numbers, "_number").select("doc_id", "digest", F.col("_gone").isNull().alias("kept"))
        return one_each(docs, settled(decided))
    return without(docs, settled(near_dedup(docs, n_words).where("not kept and doc_id is not null").select("doc_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), n_words=2)
