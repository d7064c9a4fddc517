"""Intake of event files: a stream source over a folder, and a stream sink that commits each batch of receipts once.

Both work on any store that pyarrow's file systems open by its address (local, HDFS, S3, GCS). Register them with
`spark.dataSource.register(EventFolder)` and `spark.dataSource.register(Receipts)`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Largest event in bytes; a larger one is refused without being read whole.
MOST_BYTES = 256 * 1024
#: Event files that a task reads.
FILES_A_TASK = 256


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; a plain path is a local one."""
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


@dataclass
class Files(InputPartition):
    names: list[str]


class EventReader(DataSourceStreamReader):
    """Reads the files <name>.<client>.json of a folder once each, in the order of their names.

    The offset is the last name. Names must ascend with time, as those that begin with it do: a file whose name isn't
    after the offset isn't read. Files stay where they are, so that a batch can be read again after a failure.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("mostbytes", MOST_BYTES))
        self.allowed = set(filter(None, options["clients"].split(","))) if "clients" in options else None

    def _names(self) -> list[str]:
        store, path = opened(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        names = [n for n in self._names() if start["after"] < n <= end["after"]]
        return [Files(names[i : i + FILES_A_TASK]) for i in range(0, len(names), FILES_A_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, path = opened(self.folder)
        for name in partition.names:
            client = name.removesuffix(".json").rpartition(".")[2] if name.count(".") > 1 else ""
            info = store.get_file_info(f"{path}/{name}")
            body = None
            # what its client hasn't allowed, or is too large, isn't opened
            if (self.allowed is None or client in self.allowed) and info.size <= self.most:
                with store.open_input_stream(info.path) as f:
                    body = f.read().decode("utf-8", "replace")
            yield name, client, int(info.size), body

    def commit(self, end: dict) -> None:
        pass


class EventFolder(DataSource):
    """Format "event_folder"; options: path, clients (those whose files may be opened; all if not given), mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "event_folder"

    def schema(self) -> str:
        return "name string, client string, size bigint, body string"

    def streamReader(self, schema: StructType) -> EventReader:
        return EventReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class ReceiptsWriter(DataSourceStreamArrowWriter):
    """Writes parts under parts/ and names them in commits/<batch>.json when the batch is whole.

    A batch that comes again after a restart is already named: its second parts are deleted and the first ones hold.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.folder)
        writer, name = None, f"{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    store.create_dir(f"{path}/parts", recursive=True)
                    writer = pq.ParquetWriter(f"{path}/parts/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
        if writer is None:
            return Written([])
        writer.close()
        return Written([name])

    def _drop(self, messages: list) -> None:
        store, path = opened(self.folder)
        for name in (n for m in messages if m for n in m.parts):
            store.delete_file(f"{path}/parts/{name}")

    def commit(self, messages: list, batchId: int) -> None:
        store, path = opened(self.folder)
        named = f"{path}/commits/{batchId:012d}.json"
        if store.get_file_info(named).is_file:
            self._drop(messages)
            return
        store.create_dir(f"{path}/commits", recursive=True)
        draft = f"{path}/commits/.{batchId:012d}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write("".join(json.dumps({"batch": batchId, "part": n}) + "\n" for m in messages if m for n in m.parts).encode())
        store.move(draft, named)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class Receipts(DataSource):
    """Format "receipts", for writeStream in append mode; option: path."""

    @classmethod
    def name(cls) -> str:
        return "receipts"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ReceiptsWriter:
        return ReceiptsWriter({k.lower(): v for k, v in self.options.items()})


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The receipts of whole batches, with their batch; parts that no commit names are left out."""
    named = spark.read.schema("batch bigint, part string").json(f"{folder}/commits")
    parts = spark.read.schema(schema).parquet(f"{folder}/parts").withColumn("part", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return parts.join(named, "part").drop("part")
