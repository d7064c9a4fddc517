"""Vectors: hashed embeddings, cosine search in blocks, nearest-neighbour edges and mean vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.ranking import top
from passagework.session import small_batches

#: Asked vectors that are broadcast at most.
BLOCK = 2000
#: Numbers in the asked vectors, and in the rows, of a pair of blocks, which is a task's work; blocks of each side there are at least, for many tasks.
ASKED_CELLS, ROW_CELLS, LEAST_BLOCKS = 2**21, 2**22, 8
#: Asked vectors and rows whose products are held at once.
TILE = 1024, 2048


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    m = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


class _Nearest:
    """The n best rows so far for some asked vectors, while rows go by: by the score rounded to 10 decimals, then the id.

    Products in single precision, whose error has a bound for vectors of length one, tell which rows can't be among the
    best. The others, few after the first ones, are scored again in double precision, so nothing is lost.
    """

    def __init__(self, ids: np.ndarray, asked: np.ndarray, n: int) -> None:
        self.ids, self.asked, self.rough, self.n = ids, asked, asked.astype(np.float32), n
        self.error = (asked.shape[1] + 4) * 2.0**-24 + 1e-9
        self.least = np.full(len(ids), -np.inf)
        self.q, self.id, self.raw = np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        left, right = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
        own_q = np.repeat(np.arange(len(self.ids)), right - left)
        own_r = order[np.arange(len(own_q)) + np.repeat(right - np.cumsum(right - left), right - left)]
        for begin in range(0, len(ids), TILE[1]):
            part, end = rows[begin : begin + TILE[1]], min(begin + TILE[1], len(ids))
            rough = self.rough @ part.T.astype(np.float32)
            own = (own_r >= begin) & (own_r < end)
            rough[own_q[own], own_r[own] - begin] = -np.inf
            if end - begin > self.n and not np.isfinite(self.least).all():
                self.least = np.maximum(self.least, np.partition(rough, end - begin - self.n, axis=1)[:, -self.n] - 2 * self.error)
            self._take(rough, ids[begin:end], part)

    def _take(self, rough: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        # in single precision, and not more than it was
        least = np.nextafter(self.least.astype(np.float32), np.float32(-np.inf))
        q, r = np.divmod(np.flatnonzero((rough >= least[:, None]).ravel()), len(ids))
        if not np.isfinite(least).all():
            there = np.isfinite(rough[q, r])
            q, r = q[there], r[there]
        if not len(q):
            return
        step = 2**14
        raw = np.concatenate([np.einsum("ij,ij->i", self.asked[q[i : i + step]], rows[r[i : i + step]]) for i in range(0, len(q), step)])
        q, id_, raw = np.concatenate([self.q, q]), np.concatenate([self.id, ids[r]]), np.concatenate([self.raw, raw])
        order = np.lexsort((id_, -np.round(raw, 10), q))
        q, id_, raw = q[order], id_[order], raw[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last, best = place == self.n - 1, place < self.n
        self.least[q[last]] = np.maximum(self.least[q[last]], raw[last] - 2 * self.error)
        self.q, self.id, self.raw = q[best], id_[best], raw[best]


_FOUND = "query_id bigint, id bigint, raw double"


def _tiles(ids: np.ndarray, asked: np.ndarray, n: int) -> list[_Nearest]:
    return [_Nearest(ids[i : i + TILE[0]], asked[i : i + TILE[0]], n) for i in range(0, len(ids), TILE[0])]


def _found(tiles: list[_Nearest]) -> pa.Table:
    both = lambda kind, xs: pa.array(np.concatenate([np.zeros(0, kind), *xs]).astype(kind))
    return pa.table({"query_id": both("int64", (t.ids[t.q] for t in tiles)), "id": both("int64", (t.id for t in tiles)), "raw": both("float64", (t.raw for t in tiles))})


def nearest(asked: DataFrame, rows: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """(query_id, key, raw, score, rank): the n best rows by cosine for each asked vector, itself left out.

    Up to BLOCK asked vectors are sent to the rows, which stay where they are; each partition hands on its n best a
    query. More of them are dealt into blocks, and every block of queries meets every block of rows as matrices. The
    search is exact, so its products are the square of the rows; blocks have a fixed size, so memory isn't.
    Ranks go by the score, which is raw rounded to 10 decimals; ties go to the key.
    """
    own = [F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")]
    few = asked.select(*own).limit(BLOCK + 1).toArrow()
    if len(few) <= BLOCK:
        held = rows.sparkSession.sparkContext.broadcast((few.column("id").to_numpy(), _unit(few.column("v"))))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles = _tiles(*held.value, n)
            for b in batches:
                if len(b):
                    ids, unit = b.column(0).to_numpy(), _unit(b.column(1))
                    for t in tiles:
                        t.meet(ids, unit)
            yield from _found(tiles).to_batches()

        found = rows.select(*own).mapInArrow(search, _FOUND)
    else:
        count, width = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
        blocks, asked_blocks = (max(-(-m * (width or 1) // cells), min(LEAST_BLOCKS, -(-m // BLOCK)), 1) for m, cells in ((count, ROW_CELLS), (asked.count(), ASKED_CELLS)))
        number = lambda m, name: F.pmod(F.xxhash64(key), F.lit(m)).cast("int").alias(name)
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        data = rows.select(*own, number(blocks, "block")).withColumn("asked", each(asked_blocks))
        queries = asked.select(*own, number(asked_blocks, "asked")).withColumn("block", each(blocks))

        def multiply(q: pa.Table, r: pa.Table) -> pa.Table:
            tiles = _tiles(q.column("id").to_numpy(), _unit(q.column("v")), n) if len(r) else []
            if tiles:
                ids, unit = r.column("id").to_numpy(), _unit(r.column("v"))
                for t in tiles:
                    t.meet(ids, unit)
            return _found(tiles)

        found = queries.groupBy("asked", "block").cogroup(data.groupBy("asked", "block")).applyInArrow(multiply, _FOUND)
    return top(found.withColumn("score", F.round("raw", 10)), ["query_id"], [F.desc("score"), F.asc("id")], n).withColumnRenamed("id", key)


def knn_edges(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, weight, raw), a < b: each row's k nearest with a positive score; the larger weight of a pair, rounded and raw."""
    found = nearest(rows, rows, key, vector, k).where("score > 0")
    pair = found.select(F.least("query_id", key).alias("a"), F.greatest("query_id", key).alias("b"), "raw", "score")
    return pair.groupBy("a", "b").agg(F.max("score").alias("weight"), F.max("raw").alias("raw"))


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): the mean vector of each group, scaled to length one."""
    mean = rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy(group).agg((F.sqrt(F.sum(F.col("x") * F.col("x"))) + 1e-9).alias("norm"))
    return mean.join(norm, group).select(group, "pos", (F.col("x") / F.col("norm")).alias("value"))


_TOKEN = re.compile(r"\w{2,}")


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """Each word of two or more characters adds one at a slot of its BLAKE2b hash, or takes one where the next byte is even; length one; without words the first axis."""
    v = np.zeros(dim)
    for token in _TOKEN.findall((text or "").lower()):
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] & 1 else -1.0
    norm = np.linalg.norm(v)
    if norm:
        return v / norm
    v[0] = 1.0
    return v


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, vector array<float>) of every whole text, a small batch of texts at a time."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "vector": [hashed_vector(t, dim).astype(np.float32) for t in b[text]]})

    return rows.select(key, text).mapInPandas(run, f"{key} bigint, vector array<float>")
