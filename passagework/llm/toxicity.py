"""Toxicity: every maximal scoring segment of token log-odds, judged by the extreme-value law of clean text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import Words, lean, owners, slices, span_hashes, words
from passagework.llm.quality import held_out, labelled_sample
from passagework.llm.shared import settled, table

#: Labelled rows that token statistics and the calibration are learned from at most, chosen by a hash of doc_id.
TRAINING_ROWS = 24_000
#: Buckets of the token hash.
BUCKETS = 1 << 20
#: Weight of the Dirichlet prior, as a share of all token counts; least z-score for a token to count as toxic.
PRIOR, LEAST_Z = 0.1, 2.6
#: A token counts only after so many different neighbours in toxic text (of 64 hashed ones): copies of one text have few.
LEAST_NEIGHBOURS = 4
#: A segment with a larger expected number of equals in clean text isn't significant.
SIGNIFICANT = 0.05

_EDGE = np.ones(256, bool)
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = _EDGE[128:] = False


@dataclass(frozen=True)
class Model:
    """Log-odds by bucket, what an ordinary token costs, lambda of the extreme-value law, and the logistic calibration."""

    odds: np.ndarray
    decay: float
    lam: float = 1.0
    slope: float = 1.0
    intercept: float = -3.0


def tokens(w: Words) -> np.ndarray:
    """A bucket for each word, lower-cased and without ASCII marks at its ends."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    starts, ends = w.starts.copy(), w.ends.copy()
    live = np.arange(len(starts))
    while len(live := live[(ends[live] > starts[live])]) and len(live := live[_EDGE[w.data[ends[live] - 1]]]):
        ends[live] -= 1
    live = np.arange(len(starts))
    while len(live := live[(ends[live] > starts[live])]) and len(live := live[_EDGE[w.data[starts[live]]]]):
        starts[live] += 1
    return (span_hashes(w.data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    A segment is maximal if every proper part scores less and none that contains it has that property. Neighbours
    of one sign are merged first, so the scan visits runs of positive tokens only.
    """
    hot = np.flatnonzero(values > 0)
    if not len(hot):
        return []
    total = np.append(0.0, np.cumsum(values))
    gaps = np.flatnonzero(np.diff(hot) > 1)
    begins, ends = hot[np.append(0, gaps + 1)], hot[np.append(gaps, len(hot) - 1)] + 1
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, index of the nearest with less before
    for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
        low, high = total[s], total[e]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((s, e, low, high, j))
                break
            s, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def learn(sample: DataFrame) -> Model:
    """Fit on a settled sample (doc_id, text, label): token counts are summed by bucket on the executors."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
        near = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            label = batch.column(2).to_numpy()
            for row, part in slices(batch.column(1)):
                w = words(part, lower=True)
                bucket, text = tokens(w), owners(w.first)
                for y in (0, 1):
                    kept[y] += np.bincount(bucket[label[row + text] == y], minlength=BUCKETS)
                bad = np.flatnonzero((label[row + text] == 1) & (np.arange(len(text)) > w.first[text]))
                np.bitwise_or.at(near, bucket[bad], np.int64(1) << (bucket[bad - 1] & 63))
        at = np.flatnonzero(kept[0] + kept[1])
        yield pa.record_batch([pa.array(x) for x in (at, kept[1][at], kept[0][at], near[at])], ["bucket", "bad", "good", "near"])

    found = sample.select("doc_id", "text", "label").mapInArrow(lean(counts), "bucket bigint, bad bigint, good bigint, near bigint")
    found = found.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_count(F.bit_or("near")).alias("near"))
    # what reaches the driver is bounded by the number of buckets
    counted = found.toPandas()
    at = counted["bucket"].to_numpy("int64")
    bad, good, near = (counted[c].to_numpy("float64") for c in ("bad", "good", "near"))
    odds = np.zeros(BUCKETS, np.float32)
    if bad.sum() and good.sum():
        prior = PRIOR * (bad + good)

        def logit(n: np.ndarray) -> np.ndarray:
            return np.log((n + prior) / (n.sum() + prior.sum() - n - prior))

        delta = logit(bad) - logit(good)
        z = delta / np.sqrt(1 / (bad + prior) + 1 / (good + prior))
        # words between toxic ones occur in toxic documents as well, but no more often than elsewhere
        keep = (z >= LEAST_Z) & (near >= LEAST_NEIGHBOURS) & (delta > math.log(4))
        # the largest log-odds say little more than that clean text lacks the token; alone they would set lambda
        odds[at[keep]] = np.minimum(delta[keep], np.median(delta[keep]) if keep.any() else 0)
        decay = -0.35 * float(np.median(delta[keep])) if keep.any() else -1.0
    else:
        decay = -1.0
    scored = np.where(odds[at] > 0, odds[at], decay)
    return calibrated(sample, Model(odds, decay, exponent(good, scored)))


def exponent(counts: np.ndarray, odds_of: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 over clean tokens: how fast chance segments die out."""
    p = counts / max(counts.sum(), 1)
    if not (odds_of > 0).any() or p @ odds_of >= 0:
        return 1.0
    if not (p * (odds_of > 0)).any():  # clean text has no such token: together they are rarer than one in all of it
        p = p + (odds_of > 0) / (max(counts.sum(), 1) * (odds_of > 0).sum())
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * odds_of.astype(float), 500)) < 1 else (low, mid)
    return max(low, 1e-3)


def evidence(values: np.ndarray, lam: float) -> tuple[float, list[tuple[int, int, float]]]:
    """(-log of the chance that clean text of this length has segments like these, the significant segments).

    Clean text of n tokens has about n exp(-lambda s) segments of score s. The best r segments have, to first
    order, the chance of their summed normalised scores over (r - 1)!; the r that surprises most counts.
    """
    found = segments(values)
    if not found:
        return 0.0, []
    normal = [(lam * x - math.log(len(values)), s, e, x) for s, e, x in found]
    passages = [(s, e, x) for n, s, e, x in normal if n >= -math.log(SIGNIFICANT)]
    best = total = 0.0
    for r, (n, *_) in enumerate(sorted(normal, reverse=True), 1):
        if n <= 0:
            break
        total += n
        best = max(best, total + math.lgamma(r))
    return best, passages


def judged(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(strength of evidence, significant passages as word ranges) of each text."""
    strength, passages = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for row, part in slices(texts):
        w = words(part, lower=True)
        odds = model.odds[tokens(w)].astype(np.float64)
        before = np.append(0, np.cumsum(odds > 0))
        for i in np.flatnonzero(before[w.first[1:]] > before[w.first[:-1]]):
            value = odds[w.first[i] : w.first[i + 1]]
            strength[row + i], passages[row + i] = evidence(np.where(value > 0, value, model.decay), model.lam)
    return strength, passages


def calibrated(sample: DataFrame, model: Model) -> Model:
    """The model with a logistic curve from strength to probability, fitted on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(judged(batch.column(0), model)[0]), batch.column(1)], ["strength", "label"])

    rows = sample.select("text", "label").mapInArrow(lean(run), "strength double, label int").toPandas()
    if rows["label"].nunique() < 2:
        return model
    x, y = np.log1p(rows["strength"].to_numpy()), rows["label"].to_numpy("float64")
    theta, both = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-both @ theta))
        theta = theta + np.linalg.solve((both.T * (p * (1 - p))) @ both + 1e-2 * np.eye(2), both.T @ (y - p) - 1e-2 * theta)
    return Model(model.odds, model.decay, model.lam, float(theta[0]), float(theta[1]))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every whole text.

    passages are the significant segments as word ranges with their scores. Null and empty texts have none and get
    the lowest score; repeated rows are judged alike; further columns are ignored; an empty table gives no rows. Tokens that
    aren't toxic count one cost each, model.decay, whatever their own log-odds: those of ordinary words are noise.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            strength, passages = judged(batch.column(1), model)
            score = 1 / (1 + np.exp(-(model.slope * np.log1p(strength) + model.intercept)))
            spans = pa.array([[{"first_word": s, "end_word": e, "score": x} for s, e, x in p] for p in passages], kind)
            yield pa.record_batch([batch.column(0), pa.array(score), spans], ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, score double, passages array<struct<first_word bigint, end_word bigint, score double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(settled(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", TRAINING_ROWS)))
    return detect(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
