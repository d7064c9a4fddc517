"""A keyed table under concurrent writers: an optimistic log of commits, each put in place only if its version is still free.

A table is a folder: data/ has the changed rows of every commit, log/ a small JSON file a version. A reader sees the rows of
whole versions only. A writer reads a version, works, and commits; if others committed rows that it read or wrote it
starts again from what they left, else its version is the next free one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer committed rows that this one read or wrote."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; of several writers one is told True, and no reader sees half a file.

    By a hard link on a local disk, elsewhere by a rename that fails on a file that exists, as HDFS has it. A store without such a rename needs a lock of its own.
    """
    store, path_of = _files(spark, path)
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if store.getUri().getScheme() == "file":
        local = lambda p: urlparse(p).path if p.startswith("file:") else p
        os.makedirs(local(folder), exist_ok=True)
        with open(local(draft), "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(local(draft), local(path))
        except FileExistsError:
            return False
        finally:
            os.remove(local(draft))
        return True
    out = store.create(path_of(draft), False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not store.exists(path_of(path)) and store.rename(path_of(draft), path_of(path)):
        return True
    store.delete(path_of(draft), False)
    return False


def history(spark: SparkSession, folder: str) -> list[dict]:
    """The commits in order, a dict each: version, base, data, whole. Their number is that of writes, not of rows."""
    store, path_of = _files(spark, folder)
    if not store.exists(path_of(f"{folder}/log")):
        return []
    names = sorted(s.getPath().getName() for s in store.listStatus(path_of(f"{folder}/log")))
    kept = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    rows = spark.read.schema("version bigint, base bigint, data string, whole boolean").json([f"{folder}/log/{n}" for n in kept]) if kept else None
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["version"]) if rows is not None else []


def latest(spark: SparkSession, folder: str) -> int:
    """The last version; -1 of a table without any."""
    return max((c["version"] for c in history(spark, folder)), default=-1)


def snapshot(spark: SparkSession, folder: str, key: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one), one a key, as of the schema; an empty table before the first commit."""
    commits = [c for c in history(spark, folder) if version is None or c["version"] <= version]
    begin = max((i for i, c in enumerate(commits) if c["whole"]), default=0)
    if not commits:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _version bigint, _gone boolean").parquet(*(f"{folder}/data/{c['data']}" for c in commits[begin:]))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_version").alias("_r"))
    return last.where("not _r._gone").select("_r.*").drop("_version", "_gone")


def commit(spark: SparkSession, folder: str, changed: DataFrame, key: str, base: int, read: DataFrame | None = None, gone: DataFrame | None = None, whole: bool = False) -> int:
    """Add the changed rows, and the keys that are gone, to the table as of version `base`; returns the new version.

    `read` has the keys that the change rests on beside those it writes. Rows of a key must not repeat. Raises Conflict,
    and leaves no trace that a reader sees, if a commit since base touched any of these keys.
    """
    name = uuid.uuid4().hex
    rows = changed.withColumn("_gone", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.select(key).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    touched = rows.select(key) if read is None else rows.select(key).unionByName(read.select(key))
    written = None
    while True:
        commits = history(spark, folder)
        newer = [c for c in commits if c["version"] > base]
        if newer:
            others = spark.read.parquet(*(f"{folder}/data/{c['data']}" for c in newer)).select(key)
            if any(c["whole"] for c in newer) or whole or not others.join(touched, key, "left_semi").isEmpty():
                raise Conflict(f"versions {newer[0]['version']} to {newer[-1]['version']} touched the same keys")
        version = max((c["version"] for c in commits), default=-1) + 1
        # rows carry the version they were written for; if another writer takes it they are written again
        if written != version:
            rows.withColumn("_version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/data/{name}-{version}")
            written = version
        record = {"version": version, "base": base, "data": f"{name}-{version}", "whole": whole}
        if put_if_absent(spark, f"{folder}/log/{version:012d}.json", json.dumps(record)):
            return version


def update(spark: SparkSession, folder: str, key: str, schema: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Commit change(snapshot), the rows to add or replace; on a conflict change is called again on what the others left."""
    for left in range(tries, 0, -1):
        base = latest(spark, folder)
        try:
            return commit(spark, folder, change(snapshot(spark, folder, key, schema, base)), key, base)
        except Conflict:
            if left == 1:
                raise
    raise ValueError("no tries")


def compacted(spark: SparkSession, folder: str, key: str, schema: str) -> int:
    """Write the last version whole, so that readers needn't go further back; conflicts with any commit meanwhile."""
    base = latest(spark, folder)
    return commit(spark, folder, snapshot(spark, folder, key, schema, base), key, base, whole=True)
