"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import Words, lean, mixed, owners, slices, span_hashes, words
from passagework.llm.shared import one_text_each, table

#: Labelled rows that the model is trained on at most, chosen by a hash of doc_id; the bound keeps training in one small task.
TRAINING_ROWS = 8192
#: Buckets of the feature hash.
BUCKETS = 1 << 18
#: Of the regularised leader: step, smoothing, L1, L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 0.1, 4

_UPPER, _LOWER, _DIGIT, _MARK, _WIDE, _SAME = (1 << i for i in range(6))
_SHAPE = np.full(256, _MARK, np.uint8)
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 0
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = _UPPER, _LOWER, _DIGIT, _WIDE


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every occurrence: word unigrams and bigrams, and the same of the words' shapes.

    A shape is the set of byte classes in a word, its last byte if that is a mark, and whether it repeats the word
    before; so n-grams of shapes say of unknown words what those of known words cannot.
    """
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = owners(w.first)
    word = span_hashes(w.data, w.starts, w.ends)
    shape = np.bitwise_or.reduceat(_SHAPE[w.data], w.starts).astype(np.uint64)
    # reduceat runs on to the next word's start; the class of white space is zero and adds nothing
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    tail = w.data[w.ends - 1].astype(np.uint64)
    shape |= np.where(same, np.uint64(_SAME), np.uint64(0)) | np.where(_SHAPE[w.data[w.ends - 1]] == _MARK, tail, np.uint64(0)) << np.uint64(8)
    shape = mixed(shape + np.uint64(1 << 40))
    joint = text[1:] == text[:-1]
    pairs = [mixed(h[:-1][joint] * np.uint64(3) + h[1:][joint] + np.uint64(k)) for k, h in enumerate((word, shape))]
    every = np.concatenate([word, shape, *pairs])
    return (every % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, text, text[1:][joint], text[1:][joint]])


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability for each text: the dot product of its counts, scaled by the root of their number, with the weights."""
    out = np.empty(len(texts))
    for row, part in slices(texts):
        bucket, text = features(words(part))
        total = np.bincount(text, minlength=len(part))
        dot = np.bincount(text, weights=weights[bucket], minlength=len(part)) / np.sqrt(np.maximum(total, 1))
        out[row : row + len(part)] = 1 / (1 + np.exp(-np.clip(dot + bias, -30, 30)))
    return out


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights after FTRL-proximal updates over (buckets, values, label) in the given order; the last weight is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        free = np.sign(z[at]) * L1 - z[at]
        free[(np.abs(z[at]) <= L1) & (at < BUCKETS)] = 0
        return free / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(passes):
        for bucket, value, label in rows:
            at, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents that may be learned from, by order of a hash.

    Rows whose crc32(doc_id) leaves 1 modulo 3 are held out. Of repeated labels the smallest holds, of repeated
    documents one. The ids are bounded, so they are broadcast and the other texts stay where they are.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    usable = usable.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return one_text_each(docs, usable)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on the bounded sample: executors make the sparse rows, one small task follows the leader over them.

    A row has BUCKETS values at most, however long its text. Null and empty texts teach the bias alone; without rows all weights are zero.
    """

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(batch.column(1)):
                bucket, text = features(words(part))
                key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
                text, bucket = key // BUCKETS, key % BUCKETS
                total = np.bincount(text, weights=count, minlength=len(part))
                value = (count / np.sqrt(np.maximum(total, 1))[text]).astype(np.float32)
                ends = np.searchsorted(text, np.arange(1, len(part)))
                lists = [pa.array([x.astype(t) for x in np.split(v, ends)], pa.list_(p)) for v, t, p in ((bucket, np.int32, pa.int32()), (value, np.float32, pa.float32()))]
                yield pa.record_batch([batch.column(0).slice(row, len(part)), batch.column(2).slice(row, len(part)), *lists], ["doc_id", "label", "bucket", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for d, y, b, v in zip(*(batch.column(i) for i in range(4)), strict=True):
                rows.append((d.as_py(), np.asarray(b.values), np.asarray(v.values), y.as_py()))
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % 2**64, r[3]))
        weights, bias = follow_leader([r[1:] for r in rows])
        yield pa.record_batch([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(lean(sparse), "doc_id bigint, label int, bucket array<int>, value array<float>")
    model = rows.repartition(1).mapInArrow(lean(fit), "weights binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def score_column(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every whole text.

    Null and empty texts get the bias alone; repeated rows and rows without a doc_id are scored each, alike; further
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1), shared.value, bias))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAINING_ROWS))
    return score_column(docs, weights, bias).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
