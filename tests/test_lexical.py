"""Search in the row agrees with the plain BM25 plan and with loops."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import lexical, passages, ranking
from passagework.queries import search

WORDS = ["kurul", "kurulum", "kurulumlar", "rapor", "raporu", "on", "at", "zebra", "ölçü", "Straße", "x"]


def corpus(spark, n=300, seed=3):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(WORDS, k=draw.randint(0, 12))) for _ in range(n)]
    rows = [(f"k{i:04d}", t) for i, t in enumerate(texts)] + [(f"copy{i:03d}", "zebra rapor") for i in range(60)] + [("null", None), ("empty", ""), ("long", "rapor " * 5000)]
    return spark.createDataFrame(rows, "k string, text string").repartition(5)


def questions(spark):
    return spark.createDataFrame([(1, "kurulum raporu"), (2, "zebra zebra on"), (3, "nothing here"), (4, ""), (5, None), (6, "ölçü straße at")], "q int, ask string")


@pytest.mark.parametrize("prefixes", [False, True])
@pytest.mark.parametrize("at_once", [1, 50, 1_000_000])
def test_best_is_the_plain_plan(spark, monkeypatch, prefixes, at_once):
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    d, asked = corpus(spark), passages.query_terms(questions(spark), "q", "ask", prefixes)
    plain = ranking.top(passages.bm25(d, ["k"], "text", asked, "q"), ["q"], [F.desc("score"), F.asc("k")], 7)
    want = {(r["q"], r["rank"]): (r["k"], r["score"]) for r in plain.collect()}
    got = {(r["q"], r["rank"]): (r["k"], r["score"]) for r in lexical.best(d, "k", "text", asked, "q", 7).collect()}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()} and len(want) >= 21
    assert all(got[p][1] == pytest.approx(want[p][1], abs=1e-9) for p in want)


def test_scope_leaves_statistics_alone(spark):
    d, asked = corpus(spark), passages.query_terms(questions(spark), "q", "ask")
    among = d.where("k like 'k00%'").select("k")
    every = passages.bm25(d, ["k"], "text", asked, "q").where("k like 'k00%'")
    want = {(r["q"], r["rank"]): r["k"] for r in ranking.top(every, ["q"], [F.desc("score"), F.asc("k")], 5).collect()}
    got = {(r["q"], r["rank"]): r["k"] for r in lexical.best(d, "k", "text", asked, "q", 5, among.union(among)).collect()}
    assert got == want and want


@pytest.mark.parametrize("name", ["ASKED_TERMS", "QUESTIONS"])
def test_many_questions_are_scored_by_shuffles(spark, monkeypatch, rows, name):
    d, asked = corpus(spark), passages.query_terms(questions(spark), "q", "ask")
    own = ["q", "k", "rank"]
    want = rows(lexical.best(d, "k", "text", asked, "q", 4).select(own))
    monkeypatch.setattr(lexical, name, 2)
    assert rows(lexical.best(d, "k", "text", asked, "q", 4).select(own)) == want


def test_found_counts_terms(spark):
    d = spark.createDataFrame([(1, "kurulumu bitti"), (2, "kurul kurul"), (3, None), (4, ""), (4, "bitti")], "k int, text string")
    got = sorted((r["k"], r["len"], dict(zip(r["terms"], r["times"]))) for r in lexical.found(d, "k", "text", ["bitti", "kuru*", "kurulumu"]).collect())
    assert got == [(1, 2, {0: 1, 1: 1, 2: 1}), (2, 2, {1: 2}), (4, 0, {}), (4, 1, {0: 1})]


def test_nothing_asked_and_nothing_there(spark):
    d, q = corpus(spark, 5), questions(spark)
    none = passages.query_terms(q.where("q = 5"), "q", "ask")
    assert lexical.best(d, "k", "text", none, "q", 3).count() == 0
    asked = passages.query_terms(q, "q", "ask")
    assert lexical.best(d.where("k = 'null'"), "k", "text", asked, "q", 3).count() == 0
    assert lexical.best(d, "k", "text", asked, "q", 3, d.where("k = 'absent'").select("k")).count() == 0


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("at_once", [1, 50, 1_000_000])
def test_most_shared_is_the_plain_plan(spark, monkeypatch, repeats, at_once):
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    d, asked = corpus(spark), passages.query_terms(questions(spark), "q", "ask")
    hits = passages.term_hits(d.where("text is not null"), ["k"], "text", asked).join(asked, "term").groupBy("q", "k").agg(F.sum("tf" if repeats else F.lit(1)).alias("n"))
    want = {(r["q"], r["rank"]): (r["k"], r["n"]) for r in ranking.top(hits, ["q"], [F.desc("n"), F.asc("k")], 7).collect()}
    index = lexical.indexed(d, "k", "text", asked)
    got = {(r["q"], r["rank"]): (r["k"], r["score"]) for r in lexical.most_shared(index, asked, "q", 7, repeats).collect()}
    assert got == want and len(want) >= 21
    monkeypatch.setattr(lexical, "ASKED_TERMS", 2)
    plain = lexical.most_shared(lexical.indexed(d, "k", "text", asked), asked, "q", 7, repeats)
    assert {(r["q"], r["rank"]): (r["k"], r["score"]) for r in plain.collect()} == want


@pytest.mark.parametrize("name", ["rrf_fusion", "pool_variants"])
def test_no_pair_of_question_and_document_is_shuffled(spark, monkeypatch, name):
    monkeypatch.setattr(passages, "term_hits", None)
    assert getattr(search, name)(spark, "/root/testdata/sf0.001").count() > 200
