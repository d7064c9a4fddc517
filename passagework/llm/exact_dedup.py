"""Exact deduplication: a minimal perfect hash over the distinct digests of history, byte-checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import mixed
from passagework.llm.shared import attach, one_each, own_ids, settled, table, text_digest, without

#: Distinct digests of a shard of the index, on average.
SHARD_KEYS = 100_000
INDEX = "shard int, levels array<binary>, digests binary, winners array<bigint>, sizes array<bigint>"


def keyed(docs: DataFrame, history: Column) -> DataFrame:
    """(doc_id, digest, history): SHA-256 of the text after lower-casing A-Z only; null text is empty."""
    return docs.select("doc_id", text_digest().alias("digest"), F.coalesce(history, F.lit(False)).alias("history"))


def _asked(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of a level that each digest asks for: by the next 8 bytes at each level, so digests that agree in some part later."""
    part = 8 * (level % 4)
    keys = digests[:, part : part + 8].copy().view("<u8").ravel()
    return (mixed(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


def _slots(digests: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each digest (rows of 32 bytes): at the first level whose bit is set, its rank; -1 if no level has it.

    Foreign digests also get slots; only the comparison of full digests tells them apart.
    """
    slot = np.full(len(digests), -1, np.int64)
    before = 0
    for k, bits in enumerate(levels):
        open_ = np.flatnonzero(slot < 0)
        if not len(open_):
            break
        at = _asked(digests[open_], k, len(bits))
        hit = bits[at]
        slot[open_[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before += int(bits.sum())
    return slot


def perfect_hash(digests: np.ndarray) -> list[np.ndarray]:
    """Levels of bits: a key owns the bit that no other remaining key asks for; the others go on to the next level.

    The number of set bits equals the number of keys, so slots are minimal. Digests are distinct.
    """
    levels: list[np.ndarray] = []
    while len(digests):
        size = 2 * len(digests) + 1
        at = _asked(digests, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        digests = digests[~bits[at]]
    return levels


def _matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(list(shard["digest"]))
    levels = perfect_hash(digests)
    order = np.empty(len(digests), np.int64)
    order[_slots(digests, levels)] = np.arange(len(digests))
    return pd.DataFrame({
        "shard": [int(shard["shard"].iat[0])],
        "levels": [[np.packbits(b).tobytes() + len(b).to_bytes(8, "little") for b in levels]],
        "digests": [digests[order].tobytes()],
        "winners": [shard["winner"].to_numpy("int64")[order]],
        "sizes": [shard["n"].to_numpy("int64")[order]],
    })


def _level(blob: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob[:-8], np.uint8), count=int.from_bytes(blob[-8:], "little")).astype(bool)


def _look_up(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The winner and size that history holds for each asked digest; null where the bytes in its slot differ."""
    old, size = [None] * len(asked), [0] * len(asked)
    if len(index) and len(asked):
        levels = [_level(b) for b in index["levels"].iat[0]]
        digests, held = _matrix(list(asked["digest"])), np.frombuffer(index["digests"].iat[0], np.uint8).reshape(-1, 32)
        slot = _slots(digests, levels)
        same = (slot >= 0) & (held[np.maximum(slot, 0)] == digests).all(axis=1)
        winners, sizes = index["winners"].iat[0], index["sizes"].iat[0]
        for i in np.flatnonzero(same):
            old[i], size[i] = int(winners[slot[i]]), int(sizes[slot[i]])
    return pd.DataFrame({
        "digest": asked["digest"], "winner": asked["winner"].astype("Int64"), "n": asked["n"].astype("int64"),
        "old_winner": pd.array(old, "Int64"), "old_n": pd.Series(size, dtype="int64"),
    })


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard: bit levels of its perfect hash, and for each slot the full digest, winner and count.

    `history` has digest, winner and n, a row a distinct digest, winner not null.
    """
    dealt = history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(_build, INDEX)


def groups(keys: DataFrame) -> DataFrame:
    """One row a distinct digest: keep_id (largest doc_id) and group_size, from history's index and the incoming rows.

    Copies are counted before anything is looked up, so a group's size never meets in one task.
    """
    counted = keys.groupBy("digest", "history").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    counted = settled(counted)
    past = counted.where("history and winner is not null").drop("history")
    new = counted.where("not history or winner is null").groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    index = settled(build_index(past, shards))
    asked = new.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    answers = settled(
        index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
            _look_up, "digest binary, winner bigint, n bigint, old_winner bigint, old_n bigint"
        )
    )
    # repeats of history join its groups by locator; the digests that history lacks are groups of their own
    members = answers.where("old_winner is not null")
    fresh = answers.where("old_winner is null").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
    held = (
        past.join(members.select("digest", F.col("winner").alias("w"), F.col("n").alias("m")), "digest", "left")
        .select("digest", F.greatest("winner", "w").alias("keep_id"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("group_size"))
    )
    return settled(held.unionByName(fresh))


def exact_dedup(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """Decide for every row of docs (doc_id, text) whether it stays among the rows with an equal text.

    Texts are equal when identical after lower-casing A-Z; null text is empty. `history` marks the rows that
    an earlier run has seen (by default half of them, by a hash of doc_id); the result doesn't depend on it.
    Returns doc_id, digest, keep_id (the group's largest doc_id), group_size and kept, a row for each row of
    docs. Repeated rows with one doc_id are decided alike; rows without a doc_id stay only where their whole
    group has none. An empty table gives an empty result; further columns of docs are ignored.
    """
    if history is None:
        history = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    keys = settled(keyed(docs, history))
    decided = attach(keys.drop("history"), groups(keys), "digest", "group_size")
    return decided.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text left: that of the largest doc_id, and of several with it the least by all columns.

    Rows go by their doc_id and text together, so a copy takes no other row of its doc_id along. Null text is empty; of
    a group without any doc_id one row stays; repeated rows leave one; all columns stay; an empty table stays empty.
    """
    if not own_ids(docs):
        return one_each(docs, settled(exact_dedup(docs).select("doc_id", "digest", "kept")))
    return without(docs, settled(exact_dedup(docs).where("not kept").select("doc_id")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
with keyed as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), decided as (
  select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size
  from keyed
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from decided
"""
