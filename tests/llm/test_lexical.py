import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import lexical as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Every item against every document."""
    lists = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in lists), sum(len(t) for _, t in lists)
    out = []
    for item, text in items:
        scores = []
        for d, own in lists:
            score = 0
            for term in terms(text):
                if tf := own.count(term):
                    df = sum(term in t for _, t in lists)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(own) * n_docs) // length)))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "中文", "x1", "A", "common"]
    docs = [(i, rng.choice([" ", "-", "\n\x0b", "_"]).join(rng.choices(words, k=rng.randint(1, 60))) + " common") for i in range(60)]
    docs += [(100 + i, docs[i][1].upper()) for i in range(15)] + [(200, None), (201, ""), (202, ".,;"), (None, docs[3][1]), (203, "w1 " * 50_000), (204, "tie w2"), (205, "tie w2"), (205, "tie w2")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(12)] + [(20, "common common W1"), (21, None), (22, ""), (23, "nowhere"), (24, "tie tie"), (24, "tie w3"), (25, docs[3][1]), (25, docs[3][1]), (None, "w5")]
    return docs, items


def answered(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block", [2000, 5])
def test_against_all_pairs(spark, documents, pairs, block, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ITEMS", block)
    docs, items = pairs
    table = documents(*docs).withColumn("n", F.lit("clash")).withColumn("score", F.lit(0))
    assert answered(op.search(table, spark.createDataFrame([(*i, "clash") for i in items], ITEMS + ", rank string"))) == plain(docs, items)


def test_against_sql(spark, documents, pairs, folder, duck):
    docs, items = pairs
    where = folder(documents=documents(*docs), benchmark=spark.createDataFrame(items, ITEMS))
    want = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in duck(op.OP12_SQL, where, "documents", "benchmark")), key=repr)
    assert answered(op.op12_lexical_search(spark, where)) == want


def test_a_term_of_every_document(spark, documents):
    docs = [(i, "all " + f"w{i}") for i in range(6)]
    assert op.search(documents(*docs), spark.createDataFrame([(1, "all")], ITEMS)).count() == len(plain(docs, [(1, "all")]))


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert op.search(documents((1, "a")).limit(0), items).count() == 0
    assert op.search(documents((1, "a")), items.limit(0)).count() == 0
    assert answered(op.search(documents((1, "a"), (2, "b")), items)) == plain([(1, "a"), (2, "b")], [(1, "a")])


def test_long_texts_and_lists_go_in_parts(monkeypatch):
    monkeypatch.setattr(op, "PART_BYTES", 7)
    text = "Ab-cdefghijklmnop é,qR  s" * 3
    assert [t.decode() for part in op.term_lists(text.encode()) for t in part] == terms(text)
    widths = np.array([3, 0, 9, 1, 1, 1, 20, 2])
    runs = list(op._runs(np.cumsum(widths), 4))
    assert [i for a, b in runs for i in range(a, b)] == list(range(8))
    assert all(b - a == 1 or widths[a:b].sum() <= 4 for a, b in runs)


def test_heaps_hold_the_best():
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.randrange(1, 9)) for i in range(300)]
    heaps = op.Heaps(3, 4)
    for at in range(0, 300, 50):
        heaps.add(*(np.array(c) for c in zip(*rows[at : at + 50], strict=True)))
    want = [r for i in range(3) for r in sorted((x for x in rows if x[0] == i), key=lambda r: (-r[2], r[1]))[:4]]
    assert list(zip(heaps.item.tolist(), heaps.doc.tolist(), heaps.score.tolist(), strict=True)) == want
