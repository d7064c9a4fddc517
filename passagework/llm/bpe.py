"""Byte-level BPE: whole Arrow columns split by the pattern in NumPy, pieces encoded by prefix dynamic programming.

An encoding is kept as one token per byte prefix: the last token of that prefix's own encoding. It is unique,
so appending bytes extends the table, and an edit recomputes the prefixes behind it only.
"""

from __future__ import annotations

import base64
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import lean, slices, span_hashes, text_bytes
from passagework.llm.shared import table

#: The pattern whose matches are encoded separately; split_points() follows it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces that a Python worker remembers in each of two generations, pairs whose fit it remembers, and steps of
#: its automaton besides the trie's own; all are only to save time.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_STEPS = 80_000, 300_000, 100_000
#: Rows that are decoded at a time.
ROWS_OUT = 500
#: Pieces of more characters aren't told apart by a 64-bit hash, but as text.
LONG_PIECE = 48

_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE = range(5)


class Memory:
    """Packed ids of pieces seen lately; when the younger generation is full, it replaces the older one."""

    def __init__(self, limit: int = REMEMBERED) -> None:
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, piece: str) -> bytes | None:
        if (found := self.young.get(piece)) is None and (found := self.old.get(piece)) is not None:
            self.put(piece, found)
        return found

    def put(self, piece: str, ids: bytes) -> None:
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[piece] = ids


def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """What the merges of lower rank than `below` leave of a token's bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class PrefixEncoder:
    """Encodes bytes by ranks as the merge procedure does, in one pass from left to right.

    last[e] is the last token of the encoding of data[:e]. Token t ending at e is that token exactly if
    the encoding of what comes before it ends in a token u such that the pair (u, t) re-encodes to itself.
    The tokens that end at e are read off an automaton's state, longest first, so only true tokens are tried. A table
    is the pair of lists (last, state), an entry a prefix; that of the piece before is kept, and the next piece takes
    over what both begin with.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {t: r for t, r in ranks.items() if len(t) == 1}
        self.halves: dict[int, tuple[int, int]] = {r: (r, r) for r in self.ranks.values()}
        self.merged: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(parts := _parts(token, ranks, rank)) == 2:  # else no merge makes it, and no text has it
                a, b = (ranks[p] for p in parts)
                self.ranks[token], self.halves[rank], self.merged[a << 20 | b] = rank, (a, b), rank
        self.length = {r: len(t) for t, r in self.ranks.items()}
        self._automaton()
        self.before, self.table = b"", self.empty()

    def _automaton(self) -> None:
        """child: the tokens' trie by state << 8 | byte; back: the longest proper suffix in the trie; ends: all tokens (length, rank) that end in a state."""
        self.child: dict[int, int] = {}
        own, order = {}, [(0, 0)]
        for token, rank in self.ranks.items():
            state = 0
            for b in token:
                if (after := self.child.get(state << 8 | b)) is None:
                    after = self.child[state << 8 | b] = len(order)
                    order.append((state, b))
                state = after
            own[state] = (len(token), rank)
        depth = [0] * len(order)
        for state, (parent, _) in enumerate(order[1:], 1):
            depth[state] = depth[parent] + 1
        self.back, self.ends = [0] * len(order), [()] * len(order)
        for state in sorted(range(1, len(order)), key=depth.__getitem__):
            parent, b = order[state]
            back = self._step(self.back[parent], b) if parent else 0
            self.back[state] = back
            self.ends[state] = (own[state], *self.ends[back]) if state in own else self.ends[back]
        self.steps = dict(self.child)

    def _step(self, state: int, b: int) -> int:
        while (after := self.child.get(state << 8 | b)) is None:
            if not state:
                return 0
            state = self.back[state]
        return after

    def _pair(self, u: int, t: int) -> bool:
        """Whether u and t stay apart when their joined bytes are encoded: no merge across the border comes in time."""
        low, merged, halves = 1 << 62, self.merged, self.halves
        while True:
            if merged.get(u << 20 | t, low) < low:
                return False
            # undo the later of the two merges; what lies at the border then must not have merged before it
            if u > t:
                low = u
                if (half := halves[u][1]) == u:
                    low, half = t + 1, halves[t][0]
                    if half == t:
                        return True
                    t = half
                else:
                    u = half
            else:
                low = t + 1
                if (half := halves[t][0]) == t:
                    low, half = u, halves[u][1]
                    if half == u:
                        return True
                    u = half
                else:
                    t = half

    @staticmethod
    def empty() -> tuple[list[int], list[int]]:
        """The table of no bytes: no token, and the automaton's root."""
        return [-1], [0]

    def extend(self, data: bytes, table: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """Complete the table for data, given that of a prefix of it."""
        last, states = table
        steps, ends, fits = self.steps, self.ends, self.fits
        if len(steps) > len(self.child) + REMEMBERED_STEPS:
            steps = self.steps = dict(self.child)
        if len(fits) > REMEMBERED_PAIRS:
            fits.clear()
        state = states[-1]
        for e in range(len(last), len(data) + 1):
            key = state << 8 | data[e - 1]
            if (after := steps.get(key)) is None:
                after = steps[key] = self._step(state, data[e - 1])
            state = after
            states.append(state)
            for n, t in ends[state]:
                if (u := last[e - n]) >= 0:
                    pair = u << 20 | t
                    if (ok := fits.get(pair)) is None:
                        ok = fits[pair] = self._pair(u, t)
                    if not ok:
                        continue
                last.append(t)
                break
        return table

    def tokens(self, table: tuple[list[int], list[int]]) -> list[int]:
        last = table[0]
        e, found, length = len(last) - 1, [], self.length
        while e:
            t = last[e]
            found.append(t)
            e -= length[t]
        found.reverse()
        return found

    def encode(self, data: bytes) -> list[int]:
        """All ids of data; a piece that is a token itself needs no table, and one that begins as the piece before did shares its table's beginning."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        same, most = 0, min(len(data), len(self.before))
        while same < most and data[same] == self.before[same]:
            same += 1
        for column in self.table:
            del column[same + 1 :]
        self.extend(data, self.table)
        self.before = data
        found = self.tokens(self.table)
        if len(data) > LONG_PIECE:  # a long piece's table isn't kept
            self.before, self.table = b"", self.empty()
        return found


class PrefixTable:
    """An encoded piece that can grow and change: every prefix's last token is kept."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.table = encoder, data, encoder.extend(data, encoder.empty())

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.table)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; prefixes up to start keep their tokens."""
        self.data = self.data[:start] + new + self.data[end:]
        for column in self.table:
            del column[start + 1 :]
        self.encoder.extend(self.data, self.table)

    def tokens(self) -> list[int]:
        return self.encoder.tokens(self.table)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The pattern's class of every code point."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = _LETTER
        elif k == "N":
            kinds[c] = _NUMBER
    # where this Python and the pattern's own tables of Unicode differ, the latter hold
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, own in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        kinds[kinds == kind] = _OTHER
        for m in regex.finditer(own, everything):
            at = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            kinds[at] = kind
    for m in regex.finditer(r"\s+", everything):
        kinds[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = _WHITE
    kinds[0x20] = _BLANK
    return kinds


def split_points(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in code points, text i being codes[at[i]:at[i + 1]]."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    white = kind >= _BLANK
    run = np.minimum(kind, _BLANK)  # blanks and other white space form runs together
    fresh = np.zeros(n, bool)
    fresh[at[:-1][at[:-1] < n]] = True
    cut = fresh.copy()
    cut[1:] |= run[1:] != run[:-1]
    # a white run before something solid gives its last character away: to the solid run if it is a blank
    final = np.zeros(n, bool)
    final[:-1] = white[:-1] & ~white[1:] & ~fresh[1:]
    last = np.flatnonzero(final)
    cut[last] = True
    blank = last[kind[last] == _BLANK]
    cut[blank + 1] = False
    # an apostrophe alone, without a blank before it, takes one or two letters along
    mark = np.flatnonzero((codes == 0x27) & cut)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == _LETTER) & ~fresh[mark + 1]]
    one = codes[mark + 1]
    two = np.where(mark + 2 < n, codes[np.minimum(mark + 2, n - 1)], 0)
    two = np.where(fresh[np.minimum(mark + 2, n - 1)], 0, two)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for found, width in ((mark[short], 2), (mark[long], 3)):
        cut[found + 1] = False
        after = found + width
        after = after[after < n]
        cut[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(cut)


def encoded(texts: pa.Array, encode: Callable[[bytes], list[int]], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts as unsigned 32-bit integers, where each text's ids begin); each different piece is encoded once, in the order of the pieces."""
    data, at = text_bytes(texts)
    whole = data.tobytes().decode()
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[at]
    starts = split_points(codes, at)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    ends = np.append(starts[1:], len(codes))
    keys = span_hashes(codes, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_PIECE):
        keys[i] = hash(whole[starts[i] : ends[i]]) & (2**64 - 1)
    code, _ = pd.factorize(keys)
    n = int(code.max()) + 1
    where = np.empty(n, np.int64)
    where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    pieces = [whole[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    ids = list(map(memory.get, pieces))
    for piece, k in sorted((p, k) for k, (p, found) in enumerate(zip(pieces, ids, strict=True)) if found is None):
        found = encode(piece.encode())
        ids[k] = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG_PIECE:
            memory.put(piece, ids[k])
    size = np.fromiter(map(len, ids), np.int64, n) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    begin = np.cumsum(size) - size
    take = size[code]
    stop = np.cumsum(take)
    pick = np.arange(int(stop[-1])) + np.repeat(begin[code] - (stop - take), take)
    first = np.append(0, stop)[np.searchsorted(starts, at)]
    return flat[pick], first


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a .tiktoken file of ranks or a .json vocabulary of byte-level tokens."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # byte-level vocabularies write printable bytes as themselves, the others as code points from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(letter[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}


@lru_cache(1)
def _prefix_encoder(path: str) -> tuple[PrefixEncoder, Memory]:
    return PrefixEncoder(read_ranks(path)), Memory()


class Decoder:
    """The bytes of all tokens in one array, from which ids are decoded by one gather."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            pieces[i] = t
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Binary array of texts: text i is what ids[first[i]:first[i + 1]] stand for."""
        size = self.size[ids]
        stop = np.append(0, np.cumsum(size))
        data = self.data[np.arange(int(stop[-1])) + np.repeat(self.begin[ids] - stop[:-1], size)]
        return binaries(data, stop[first])


@lru_cache(1)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary array whose element i is data[at[i]:at[i + 1]], in bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _encode(ranks_path: str, decode: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memory = _prefix_encoder(ranks_path)
        for batch in batches:
            for row, part in slices(batch.column(1)):
                ids, first = encoded(part, encoder.encode, memory)
                columns = [batch.column(0).slice(row, len(part)), binaries(ids.astype("<u4").view(np.uint8), first * 4)]
                if decode:
                    columns.append(_decoder(ranks_path).decode(ids, first))
                yield pa.record_batch(columns, ["doc_id", "ids", "data"][: len(columns)])

    return run


def encode_column(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids): every whole text's token ids, packed as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows are encoded each for itself; an empty table gives no rows; further
    columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lean(_encode(ranks_path, False)), "doc_id bigint, ids binary")


def decode_column(encoded_docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the packed ids stand for; null ids stand for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks_path)
        for part in (batch.slice(a, ROWS_OUT) for batch in batches for a in range(0, batch.num_rows, ROWS_OUT)):
            packed = [x or b"" for x in part.column(1).to_pylist()]
            first = np.append(0, np.cumsum([len(x) // 4 for x in packed])).astype(np.int64)
            data = decoder.decode(np.frombuffer(b"".join(packed), "<u4"), first)
            yield pa.record_batch([part.column(0), part.column(1), data], ["doc_id", "ids", "data"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(lean(run), "doc_id bigint, ids binary, data binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, data): encode_column() and decode_column() in one pass, so that a core keeps one Python worker."""
    return docs.select("doc_id", "text").mapInArrow(lean(_encode(ranks_path, True)), "doc_id bigint, ids binary, data binary")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"), ranks_path or tokenizer_file("byte_bpe_50k.tiktoken"))
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )
