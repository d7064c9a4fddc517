"""WARC records in seekable Zstandard bundles: independent frames, a seek table at the end, and an index of records."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.arrays import lean
from passagework.llm.shared import BROADCAST_ROWS, attach, settled, shared_folder, table
from passagework.sources.intake import opened

#: Bytes of records after which a frame, and of frames after which a bundle, is closed. A record is never split.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
#: Payloads of fewer bytes are stored each.
LEAST_SHARED = 100
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the seekable format: the magic numbers of a skippable frame and of the seek table's footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """A skippable frame with each frame's compressed and decompressed size, and a footer with their number."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of a bundle, from its end alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    entry = 12 if flags & 0x80 else 8
    if magic != _SEEKABLE or len(bundle) < 17 + entry * n:
        raise ValueError("not a seekable bundle")
    at, frames = 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", bundle, len(bundle) - 9 - entry * (n - i))
        frames.append((at, packed, size))
        at += packed
    return frames


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """The record of a page and payload; `place` tells records apart that share both, and those without a page_id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit holds no payload but names the page that does."""
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-Id", name),
        ("Payload-Length", str(size)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Refers-To", record_id(refers_to, digest, "")),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("Refers-To-Page", str(refers_to)),
        ]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, content, where the next record begins) of the record at an offset of a decompressed frame."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    begin, n = stop + 4, int(head["Content-Length"])
    return head, data[begin : begin + n], begin + n + 4


def _payload():
    return F.coalesce("html", F.lit("")).cast("binary")


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size) of every row; null html is empty."""
    return pages.select("page_id", F.unhex(F.sha2(_payload(), 256)).alias("digest"), F.octet_length(_payload()).cast("long").alias("size"))


def firsts(hashed: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to): pages with a payload of LEAST_SHARED bytes or more that a smaller page_id has as well.

    `hashed` is settled. Copies are counted by digest first; the digests of the largest groups are broadcast.
    """
    large = hashed.where((F.col("size") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    groups = settled(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeated = attach(large.select("page_id", "digest"), groups, "digest", "n")
    return repeated.where("first < page_id").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to bundles: bytes of a bundle with its seek table, and where each record lies."""
    pack, part, count = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId(), 0
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.binary()), ("frame", pa.int32()), ("offset", pa.int64())]))
    frames, sizes, index, frame, held = [], [], [], [], 0

    def close_frame() -> None:
        nonlocal held
        if frame:
            data = b"".join(frame)
            frames.append(pack.compress(data))
            sizes.append((len(frames[-1]), len(data)))
            frame.clear()
            held = 0

    def close() -> pa.RecordBatch:
        nonlocal count
        close_frame()
        whole = b"".join(frames) + seek_table(sizes)
        out = pa.record_batch([pa.array([f"part-{part:06d}-{count:06d}.warc.zst"]), pa.array([whole], pa.binary()), pa.array([index], kind)], ["bundle", "data", "records"])
        count += 1
        frames.clear(), sizes.clear(), index.clear()
        return out

    for batch in batches:
        for row in range(batch.num_rows):
            page, url, data, digest, size, refers, shared = (batch.column(i)[row].as_py() for i in range(7))
            place = f"{part}-{count}-{len(index)}" if shared or page is None else ""
            one = record(page, url or "", data or b"", digest.hex(), size, refers, place)
            index.append({"record_id": record_id(page, digest.hex(), place), "page_id": page, "refers_to": refers, "digest": digest, "frame": len(frames), "offset": held})
            frame.append(one)
            held += len(one)
            if held >= FRAME_BYTES:
                close_frame()
            if sum(p for p, _ in sizes) >= BUNDLE_BYTES:
                yield close()
    if frame or frames:
        yield close()


def write(pages: DataFrame, path: str) -> None:
    """Write a record for every row of pages (page_id, url, html) into bundles at path.

    path is a Parquet table of (bundle, data, records), since only Spark's writers reach every store: data is a
    whole .warc.zst file, records its index from record ids to frame and offset within the decompressed frame, with the
    record's page, digest and the page that it refers to; export() makes files of it. Of equal
    payloads of at least LEAST_SHARED bytes the smallest page_id is a response and the others revisit it; rows
    without a page_id, and repeated rows of the first one, are responses. Every record has an id of its own; a revisit
    names that of its response unless the response's row is repeated, and its page in any case. Null html is an empty
    payload, null url an empty one; further columns are ignored; an empty table gives no bundle.
    """
    hashed = settled(payloads(pages))
    repeated = hashed.where("page_id is not null").groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id", "digest", F.lit(True).alias("shared"))
    # what the pages must be told: few rows, without texts; pages move to meet them only where they are many
    told = settled(firsts(hashed).join(repeated, ["page_id", "digest"], "full"))
    few = told.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(_payload(), 256)).alias("digest"), F.octet_length(_payload()).cast("long").alias("size"))
    met = rows.join(F.broadcast(told) if few else told, ["page_id", "digest"], "left")
    schema = "bundle string, data binary, records array<struct<record_id string, page_id bigint, refers_to bigint, digest binary, frame int, offset bigint>>"
    stored = F.when(F.col("refers_to").isNull(), _payload()).alias("payload")
    met.select("page_id", "url", stored, "digest", "size", "refers_to", "shared").mapInArrow(lean(_bundles), schema).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle in (batch.column(0)[i].as_py() for i in range(batch.num_rows)):
            for at, packed, size in read_seek_table(bundle):
                data, pos, rows = unpack.decompress(bundle[at : at + packed], max_output_size=size), 0, []
                while pos < len(data):
                    head, content, pos = parse(data, pos)
                    refers = head.get("Refers-To-Page")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if refers is None and hashlib.sha256(content).hexdigest() != digest:
                        raise ValueError("a payload differs from its digest")
                    length = int(head["Payload-Length"]) if refers is not None else len(content)
                    rows.append((int(head["Page-Id"]) if head["Page-Id"] else None, head["WARC-Target-URI"], length, digest, head["WARC-Type"], None if refers is None else int(refers), content))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "content"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles at path, each frame decompressed alone and every stored payload checked.

    A revisit has no content of its own here; fetch() follows it. A table without bundles gives no rows.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, content binary"
    return spark.read.parquet(path).select("data").mapInArrow(lean(_read), schema)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bundle the wanted frames are decompressed, one after the other."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            name, bundle, wanted = (batch.column(c)[i].as_py() for c in range(3))
            table_ = read_seek_table(bundle)
            for f in sorted({w["frame"] for w in wanted}):
                at, packed, size = table_[f]
                data = unpack.decompress(bundle[at : at + packed], max_output_size=size)
                offsets = [w["offset"] for w in wanted if w["frame"] == f]
                found = [parse(data, o)[1] for o in offsets]
                yield pa.record_batch(
                    [pa.array([name] * len(found)), pa.array([f] * len(found), pa.int32()), pa.array(offsets, pa.int64()), pa.array(found, pa.binary())], ["bundle", "frame", "offset", "content"])


def fetch(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(record_id, page_id, content) of the records that ids name by record_id, or by page_id if it has no such column (null: those without one).

    Only their frames are decompressed, by the index. A revisit has the payload of the response that it refers to; a
    payload that many revisits share is decompressed once. Repeated ids count once; ids that no record has, empty ids
    and a table without bundles give no rows.
    """
    key = "record_id" if "record_id" in ids.columns else "page_id"
    bundles = spark.read.parquet(path)
    index = bundles.select("bundle", F.inline("records"))
    asked = index.join(ids.select(F.col(key).alias("_asked")).distinct(), F.col(key).eqNullSafe(F.col("_asked"))).drop("_asked")
    asked = settled(asked)
    place = F.struct("bundle", "frame", "offset")
    named = asked.where("refers_to is not null").select(F.col("refers_to").alias("page_id"), "digest").distinct()
    first = index.where("refers_to is null").join(named, ["page_id", "digest"]).groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.min(place).alias("place"))
    revisits = asked.where("refers_to is not null").select("record_id", "page_id", "refers_to", "digest").join(first, ["refers_to", "digest"])
    placed = asked.where("refers_to is null").select("record_id", "page_id", place.alias("place")).unionByName(revisits.select("record_id", "page_id", "place")).select("record_id", "page_id", "place.*")
    wanted = placed.select("bundle", "frame", "offset").distinct().groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("wanted"))
    found = bundles.select("bundle", "data").join(wanted, "bundle").select("bundle", "data", "wanted").mapInArrow(lean(_contents), "bundle string, frame int, offset bigint, content binary")
    return placed.join(found, ["bundle", "frame", "offset"]).select("record_id", "page_id", "content")


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write every bundle of the table as a file <bundle> in folder, a store that pyarrow opens by its address; returns (bundle, bytes), settled.

    A file gets its name when it is whole, so a task that is run again leaves the same files. An empty table writes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for i, name in enumerate(names):
                draft = f"{base}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as f:
                    f.write(data := batch.column(1)[i].as_buffer())
                store.move(draft, f"{base}/{name}")
                sizes.append(data.size)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["bundle", "bytes"])

    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    return settled(spark.read.parquet(path).select("bundle", "data").mapInArrow(run, "bundle string, bytes bigint"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
with hashed as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), decided as (
  select *, case when payload_bytes >= {LEAST_SHARED} then min(page_id) over (partition by payload_digest) else page_id end as first from hashed
)
select page_id, payload_bytes, payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
       case when first < page_id then first end as refers_to
from decided
"""
