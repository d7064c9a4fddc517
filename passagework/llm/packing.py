"""Best-fit packing of tokenised documents into sequences under token, document-count and attention-cost capacities."""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import lean, slices
from passagework.llm.bpe import PATTERN, binaries, read_ranks, tokenizer_file
from passagework.llm.shared import BROADCAST_ROWS, settled, table

#: Characters after which a long text is encoded in parts, so that its ids are never a list of Python's as a whole.
PART_CHARS = 1 << 18
#: Sequences that lack a larger share of their tokens than one in TAIL_SHARE are packed anew, so many in a group.
TAIL_SHARE, GROUP_SEQUENCES = 256, 4096

_BREAK = re.compile(r"(?<=[A-Za-z0-9])(?= )")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. A piece of n tokens costs n tokens, one document and n * n of attention.

    rule "norm" takes the sequence whose residual after the piece has the smallest weighted norm; rule "dot"
    takes the one whose residual has the largest weighted dot product with the piece. The defaults for documents
    and attention never bind before tokens do.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)

    def longest(self) -> int:
        """Tokens of the longest piece that an empty sequence holds."""
        if self.documents < 1 or (most := min(self.tokens, math.isqrt(self.attention))) < 1:
            raise ValueError("a sequence must hold a token")
        return most


@dataclass
class BestFit:
    """Open sequences of one task, as residual vectors; each piece goes where one-by-one best fit would put it."""

    limits: Limits
    residual: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    name: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    used: int = 0

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece: longest first, each into the best sequence that has room in every dimension."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(-lengths, kind="stable")
        size, begin = np.unique(-lengths[order], return_index=True)
        together = self._place_equal if self.limits.rule == "norm" else self._place_in_turn
        for length, rows in zip((-size).tolist(), np.split(order, begin[1:]), strict=True):
            together(length, rows, sequence, offset)
        keep = (self.residual > 0).all(axis=1)
        self.residual, self.name = self.residual[keep], self.name[keep]
        return sequence, offset

    def _need(self, length: int) -> np.ndarray:
        need = np.array([length, 1, length * length], np.int64)
        if (need > self.limits.capacity()).any():
            raise ValueError(f"a piece of {length} tokens exceeds an empty sequence")
        return need

    def _open(self, more: int) -> np.ndarray:
        """The rows of so many fresh sequences."""
        fresh = np.arange(len(self.residual), len(self.residual) + more)
        self.residual = np.vstack([self.residual, np.tile(self.limits.capacity(), (more, 1))])
        self.name = np.append(self.name, self.used + np.arange(more))
        self.used += more
        return fresh

    def _place_equal(self, length: int, rows: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> None:
        """By the norm, which only falls as a sequence fills: the best one stays best for the next equal piece until it has no room left."""
        full, need, w = self.limits.capacity(), self._need(length), np.array(self.limits.weights)
        open_ = np.flatnonzero(self.residual[:, 0] >= length)
        room = (self.residual[open_] // need).min(axis=1)
        open_, room = open_[room > 0], room[room > 0]
        score = ((w * (self.residual[open_] - need) / full) ** 2).sum(axis=1)
        order = np.lexsort((self.name[open_], score))
        open_, room = open_[order], room[order]
        left = len(rows) - int(room.sum())
        if left > 0:
            per = int((full // need).min())
            fresh = self._open(-(-left // per))
            open_, room = np.append(open_, fresh), np.append(room, np.full(len(fresh), per))
        upto = np.cumsum(room)
        at = np.searchsorted(upto, np.arange(len(rows)), "right")
        nth = np.arange(len(rows)) - np.append(0, upto)[at]
        bins = open_[at]
        sequence[rows] = self.name[bins]
        offset[rows] = full[0] - self.residual[bins, 0] + nth * length
        np.subtract.at(self.residual, bins, need)

    def _place_in_turn(self, length: int, rows: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> None:
        """By the dot product, which falls as a sequence fills: a heap ranks the sequence anew after each piece."""
        full, need, w = self.limits.capacity(), self._need(length), np.array(self.limits.weights)
        scale = w * (need / full) / full
        open_ = np.flatnonzero((self.residual >= need).all(axis=1))
        heap = [(-float(scale @ self.residual[b]), int(self.name[b]), int(b)) for b in open_]
        heapq.heapify(heap)
        for row in rows.tolist():
            if heap:
                _, name, b = heapq.heappop(heap)
            else:
                b = int(self._open(1)[0])
                name = int(self.name[b])
            sequence[row], offset[row] = name, full[0] - self.residual[b, 0]
            self.residual[b] -= need
            if (self.residual[b] >= need).all():
                heapq.heappush(heap, (-float(scale @ self.residual[b]), name, b))


def cut(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents with so many ids; only the first may be shorter than the limit."""
    n = np.maximum(1, -(-sizes // limit))
    document = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(n) - n, n)
    head = sizes - (n - 1) * limit
    start = np.where(piece == 0, 0, head[document] + (piece - 1) * limit)
    return document, piece, start, np.where(piece == 0, head[document], limit)


@lru_cache(1)
def _tokenizer(path: str):
    """(special strings, the byte-level vocabulary's encoder by ranks); the library's own is read on demand."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return special, tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(1)
def _whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PART_CHARS: before a blank behind a letter or digit every match of the pattern ends."""
    at = 0
    while len(text) - at > PART_CHARS and (m := _BREAK.search(text, at + PART_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_ids(texts: list[str], tokenizer_path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by end_id; how many each has)."""
    special, ranks = _tokenizer(tokenizer_path)
    found, sizes = [], np.empty(len(texts), np.int64)
    end = np.array([end_id], np.uint32)
    for i, text in enumerate(texts):
        if any(s in text for s in special):  # the tokenizer itself gives such strings ids of their own
            ids = [np.array(_whole_tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids, np.uint32)]
        elif text:
            ids = [np.array(ranks.encode_ordinary(part), np.uint32) for part in _parts(text)]
        else:
            ids = []
        sizes[i] = sum(map(len, ids)) + 1
        found += [*ids, end]
    return np.concatenate(found) if found else np.zeros(0, np.uint32), sizes


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Tokenise docs (doc_id, text) and pack them, in one pass without a shuffle.

    Each task packs what it reads: about a megabyte of text at a time, longest piece first, into the sequences it has
    open, so memory holds one slice and the residuals of open sequences. A lost task packs the same rows alike again.
    Documents of more ids than a sequence can hold by any capacity are cut. Null and empty texts are the end id alone;
    repeated rows are packed each; further columns are ignored; an empty table gives no rows. Returns doc_id, piece,
    start, length, ids (little-endian unsigned 32-bit), sequence_id and offset, the pieces of a sequence following each
    other without gaps from offset 0.
    """
    limit = limits.longest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(limits)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, part in slices(batch.column(1)):
                ids, sizes = token_ids(part.to_pylist(), tokenizer_path, end_id)
                document, piece, start, length = cut(sizes, limit)
                sequence, offset = bins.place(length)
                # pieces follow each other as their ids do
                packed = binaries(ids.astype("<u4").view(np.uint8), np.append(0, np.cumsum(length)) * 4)
                names = batch.column(0).slice(row, len(part)).take(pa.array(document))
                yield pa.record_batch(
                    [names, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), packed, pa.array(base + sequence), pa.array(offset)],
                    ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def refilled(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The settled pieces with those of ill-filled sequences packed anew together, as each task of pack() leaves some at its end.

    Sequences that lack more than 1/TAIL_SHARE of their tokens are taken apart; their pieces, as rows of lengths alone,
    are dealt to groups of about GROUP_SEQUENCES sequences, and each group is packed longest first. Sequences packed anew
    have negative numbers. All columns stay; pieces are told apart by sequence_id and offset; an empty table stays empty.
    """
    size = F.col("length")
    filled = pieces.groupBy("sequence_id").agg(F.sum(size).alias("tokens"))
    tails = settled(filled.where(F.col("tokens") * TAIL_SHARE < limits.tokens * (TAIL_SHARE - 1)))
    n, tokens = tails.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if n < 2:
        return pieces
    groups = max(1, round(tokens / (limits.tokens * GROUP_SEQUENCES)))
    few = n <= BROADCAST_ROWS
    loose = pieces.select("sequence_id", "offset", "length").join(F.broadcast(tails.select("sequence_id")) if few else tails.select("sequence_id"), "sequence_id")

    def again(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sequence_id", "offset"], ignore_index=True)
        sequence, offset = BestFit(limits).place(group["length"].to_numpy("int64"))
        number = -1 - (sequence + (int(group["group"].iat[0]) << 40))
        return pd.DataFrame({"sequence_id": group["sequence_id"], "offset": group["offset"], "new_sequence": number, "new_offset": offset})

    dealt = loose.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int"))
    moved = settled(dealt.groupBy("group").applyInPandas(again, "sequence_id bigint, offset bigint, new_sequence bigint, new_offset bigint"))
    few = moved.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
    met = pieces.join(F.broadcast(moved) if few else moved, ["sequence_id", "offset"], "left")
    new = {"sequence_id": F.coalesce("new_sequence", "sequence_id"), "offset": F.coalesce("new_offset", "offset")}
    return met.select(*(new.get(c, F.col(c)).alias(c) for c in pieces.columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed pieces by sequence: sequence_id, its ids in order, and its documents."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return refilled(settled(digest(pack(table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file("byte_bpe_50k.json")))))
