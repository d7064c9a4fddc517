import math
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from passagework.llm import filter_audit as op

LABELS = "doc_id bigint, quality int, toxic int"


def plain(docs, labels):
    """Every order run over every document."""
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            text = d["text"] or ""
            first[text] = min(first.get(text, d["doc_id"]), d["doc_id"])
    rows = []
    for d in docs:
        text = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d["doc_id"] is not None and d["doc_id"] > first[text],
        }
        own = [x for x in labels if x[0] == d["doc_id"] and x[0] is not None]
        rows.append((d["source"] or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def tables(spark):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, long, "x"), (2, long, "y"), (3, long.upper(), "x"), (4, long + " #", "x"), (5, "a b " * 40, "x"), (6, None, None), (7, "", ""), (8, "", "x"), (9, "A $", "y"),
        (None, long, "x"), (None, "", None), (10, "dup", "y"), (10, "dup", "y"), (11, "dup", "x"), (12, "word " * 200_000, "y"), (13, long.replace("word", "é"), "y"), (14, "one\x0btwo three", None),
    ]
    docs = spark.createDataFrame([(*t, "clash", "clash") for t in texts], "doc_id bigint, text string, source string, mask string, part string")
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (7, 0, None), (None, 1, 1), (99, 1, 1), (10, 1, 0)]
    return docs, spark.createDataFrame(labels, LABELS)


def test_against_every_order(tables):
    docs, labels = tables
    got = sorted(map(tuple, op.audit(docs, labels).collect()))
    assert got == plain([r.asDict() for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert len(got) == 3 * 120 * 5


def test_against_sql(spark, tables, folder, duck):
    docs, labels = tables
    where = folder(documents=docs.drop("mask", "part"), labels=labels)
    got = op.op11_filter_audit(spark, where)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in got.columns) for r in duck(op.OP11_SQL, where, "documents", "labels"))


def test_paths_are_counted():
    for n in (1, 3, 5):
        found = op.lattice(n)
        assert len(found) == n * 2 ** (n - 1)
        for state, _, orders in found:
            assert orders == math.factorial(state.bit_count()) * math.factorial(n - 1 - state.bit_count())


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert op.audit(docs.limit(0), labels).count() == 0
    none = op.audit(docs, spark.createDataFrame([], LABELS))
    assert none.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


def test_long_texts_go_in_parts(monkeypatch):
    texts = ["a b\x0bc\x1cd " * 20 + " ".join(f"w{i}" for i in range(40)), "É # " * 3, "", "ABC"]
    whole = [op.failed(t.encode()) for t in texts]
    monkeypatch.setattr(op, "PART_BYTES", 5)
    assert [op.failed(t.encode()) for t in texts] == whole == [0b0010, 0b1011, 0b0001, 0b0101]
