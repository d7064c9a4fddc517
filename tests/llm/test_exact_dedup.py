import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import exact_dedup as op
from passagework.llm.near_dedup import drop_near_copies


def test_perfect_hash_is_minimal_and_checked():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    levels = op.perfect_hash(op._matrix(keys))
    slots = op._slots(op._matrix(keys), levels)
    assert sorted(slots) == list(range(5000))
    foreign = op._slots(op._matrix([hashlib.sha256(b"x%d" % i).digest() for i in range(100)]), levels)
    assert foreign.max() < 5000
    assert len(op.perfect_hash(np.zeros((0, 32), np.uint8))) == 0


def test_against_sql_with_edges(spark, documents, folder, duck):
    docs = documents((1, "Same"), (2, "sAME"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "z" * 300_000), (8, "Z" * 300_000), (9, "alone"), (9, "alone")).withColumn("digest", F.lit("clash"))
    where = folder(documents=docs)
    got = sorted((r.asDict() for r in op.op8_exact_dedup(spark, where).collect()), key=str)
    assert got == sorted(duck(op.OP8_SQL, where, "documents"), key=str)
    assert sum(r["kept"] for r in got) == 7


def test_history_changes_nothing(spark, documents):
    docs = documents(*[(i, f"text {i % 7}") for i in range(60)])
    want = sorted(map(tuple, op.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))
    for history in (F.lit(True), F.lit(False), F.col("doc_id") < 20):
        assert sorted(map(tuple, op.exact_dedup(docs, history).select("doc_id", "keep_id", "group_size", "kept").collect())) == want
    assert op.drop_copies(docs).count() == 7


def test_empty_and_null_ids(spark, documents):
    assert op.exact_dedup(documents((1, "a")).limit(0)).count() == 0
    got = {(r["doc_id"], r["kept"]) for r in op.exact_dedup(documents((None, "a"), (4, "A"), (None, "b"))).collect()}
    assert got == {(None, False), (4, True), (None, True)}


def test_one_row_of_each_text_stays(spark, documents):
    docs = documents((1, "a"), (1, "only"), (2, "A"), (2, "a"), (3, "same"), (3, "same"), (None, "A"), (None, "b"), (None, "b"), (4, None), (None, ""))
    kept = sorted(((r["doc_id"], r["text"]) for r in op.drop_copies(docs).collect()), key=str)
    assert kept == [(1, "only"), (2, "A"), (3, "same"), (4, None), (None, "b")]
    assert op.drop_copies(docs).columns == docs.columns


def test_digests_may_share_beginnings():
    keys = [b"same 8 b" + hashlib.sha256(str(i).encode()).digest()[:24] for i in range(500)]
    slots = op._slots(op._matrix(keys), op.perfect_hash(op._matrix(keys)))
    assert sorted(slots) == list(range(500))


@pytest.mark.parametrize("drop", [op.drop_copies, drop_near_copies])
def test_clashing_columns_and_maps_stay_as_they_are(documents, drop):
    docs = documents((1, "a b c d e f"), (1, "only one here"), (1, "only one here"), (2, "A b c d e f"), (None, "A b c d e f"), (None, "none of them"), (3, None), (3, None))
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("_kept", "_own", "_digest", "_id", "kept", "own", "digest", "id", "row", "stays", "_number", "n", "of_id")})
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    got = drop(docs)
    assert got.columns == docs.columns
    rows = [r.asDict() for r in got.collect()]
    assert all(r[c] == f"own {c}" for r in rows for c in ("_kept", "_own", "_digest", "_id", "row", "stays"))
    assert all(r["tags"] == {"k": r["doc_id"]} for r in rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    empty = [(3, None)] if drop is op.drop_copies else [(3, None), (3, None)]
    copies = [(2, "A b c d e f")] if drop is op.drop_copies else [(1, "a b c d e f"), (None, "A b c d e f")]
    assert kept == sorted([(1, "only one here"), *copies, (None, "none of them"), *empty], key=str)
