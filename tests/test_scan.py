import os

import pytest
from pyspark.sql import functions as F

from passagework.sources import scan
from passagework.streaming import events


def write(path, text, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (at, at))


@pytest.fixture
def notes(tmp_path):
    root = str(tmp_path / "notes")
    write(f"{root}/a.md", "---\ntitle: A\n---\nbody", 1000)
    write(f"{root}/sub/b.md", "no front matter " * 1000, 1000)
    write(f"{root}/c.md", "---\n" + "".join(f"key{i}: value {i}\n" for i in range(900)) + "---\nbody", 1000)
    write(f"{root}/.tool/d.md", "---\ntitle: hidden\n---\n", 1000)
    return root


def titles(df):
    return {r["path"]: r["t"] for r in df.select("path", F.get_json_object("front", "$.title").alias("t")).collect()}


def test_only_changed_files_are_opened(spark, notes, tmp_path):
    cache = str(tmp_path / "cache")
    df, opened = scan.scan(spark, notes, cache)
    assert opened == 3 and titles(df) == {"a.md": "A", "sub/b.md": None, "c.md": None}
    assert df.where("path = 'c.md'").select(F.get_json_object("front", "$.key899")).first()[0] == "value 899"
    # another text of one size and time isn't seen, so the file wasn't opened; a changed one is
    write(f"{notes}/a.md", "---\ntitle: Z\n---\nbody", 1000)
    assert scan.scan(spark, notes, cache)[1] == 0
    write(f"{notes}/sub/b.md", "---\ntitle: B\n---\n", 2000)
    os.remove(f"{notes}/c.md")
    df, opened = scan.scan(spark, notes, cache)
    assert opened == 1 and titles(df) == {"a.md": "A", "sub/b.md": "B"}


def test_heads_end_with_the_front_matter(tmp_path):
    root = str(tmp_path)
    write(f"{root}/long.md", "---\nx: 1\n---\n" + "body " * 100_000, 1)
    write(f"{root}/plain.md", "body " * 100_000, 1)
    write(f"{root}/open.md", "---\nnever: closed\n" + "body\n" * 5_000, 1)
    write(f"{root}/edge.md", "---\n" + "a: " + "b" * (scan.HEAD - 11) + "\n---\nbody", 1)
    assert len(scan.head(root, "long.md")) == len(scan.head(root, "plain.md")) == scan.HEAD
    assert len(scan.head(root, "open.md")) == 18 + 25_000
    assert scan.front_matter(scan.head(root, "edge.md"))[0] == {"a": "b" * (scan.HEAD - 11)}


def test_probe_goes_by_the_schema(spark, tmp_path):
    schema, where = "path string, n int", str(tmp_path / "t")
    assert scan.usable(spark, where, schema) == (False, "unreadable: AnalysisException")
    spark.createDataFrame([], schema + ", more string").write.parquet(where)
    assert scan.usable(spark, where, schema) == (True, "")
    spark.createDataFrame([("a", "1")], "path string, n string").write.mode("overwrite").parquet(where)
    assert scan.usable(spark, where, schema) == (False, "foreign: n")
    assert scan.usable(spark, where, "other string, path string") == (False, "foreign: other")


def test_refresh_builds_what_changed(spark, notes, tmp_path):
    cache, index, asked = str(tmp_path / "cache"), str(tmp_path / "index"), []

    def build(files):
        asked.append(sorted(r["path"] for r in files.collect()))
        if fail:
            raise RuntimeError("no model")
        return files.select("path", F.explode(F.array(F.lit(0), F.lit(1))).alias("no")).select(F.concat_ws("#", "path", "no").alias("place"), "path")

    def run():
        return scan.refresh(spark, notes, cache, index, "place", "place string, path string", build)

    places = lambda: sorted(r["place"] for r in scan.versions.snapshot(spark, index, "place", "place string, path string, built timestamp").collect())
    fail = True
    with pytest.raises(RuntimeError):
        run()
    fail = False  # what failed is made up for
    assert run() == 3 and run() == 0 and len(places()) == 6
    write(f"{notes}/a.md", "---\ntitle: new\n---\nlonger", 3000)
    os.remove(f"{notes}/c.md")
    assert run() == 1 and places() == ["a.md#0", "a.md#1", "sub/b.md#0", "sub/b.md#1"]
    assert asked[-1] == ["a.md"]


def test_a_failed_refresh_gets_the_same_rows_again(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []

    def build(df, batch):
        got.append((batch, df.count()))
        if len(got) == 1:
            raise RuntimeError("not now")

    for _ in range(2):
        q = events.refresh(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), build, str(tmp_path / "c"), "1 second")
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001 - the failure is the test's own
            pass
        q.stop()
    assert got == [(0, 3), (0, 3)]
