import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from passagework.llm import arrays, quality, rules, toxicity


def corpus(spark, documents, n=900):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["an", "ti", "re", "on", "es"]) for _ in range(r.randrange(1, 4)))
    pairs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(60, 140))]
        junk, bad = i % 6 == 0, i % 7 == 0
        if junk:
            words = [w + "%%%" for w in words]
        if bad:
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(["scum", "idiot", "moron"]))
        pairs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    return documents(*pairs, (n, None), (n + 1, "")), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op2_quality, 1, 0.5), (toxicity.op5_toxicity, 2, 0.7)])
def test_held_out_accuracy(spark, documents, folder, query, label, least):
    docs, labels = corpus(spark, documents)
    rows = query(spark, folder(documents=docs, labels=labels)).collect()
    truth = {r[0]: r[label] for r in labels.collect() if r[0] is not None and r[label] is not None}
    assert len(rows) == 902 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95


def test_no_labels_and_no_rows(spark, documents, folder):
    docs, labels = corpus(spark, documents, 20)
    where = folder(documents=docs, labels=labels.limit(0))
    assert quality.op2_quality(spark, where).count() == 22 and toxicity.op5_toxicity(spark, where).count() == 22
    where = folder(documents=docs.limit(0), labels=labels)
    assert quality.op2_quality(spark, where).count() == 0 and toxicity.op5_toxicity(spark, where).count() == 0


def test_segments_equal_brute_force():
    def brute(v):
        """Ruzzo and Tompa's definition by recursion: take the best segment, then what lies on its two sides."""
        out, todo = [], [(0, len(v))]
        while todo:
            a, b = todo.pop()
            best = None
            for s in range(a, b):
                total = 0.0
                for e in range(s, b):
                    total += v[e]
                    if total > 0 and (best is None or total > best[0] + 1e-12):
                        best = (total, s, e + 1)
            if best:
                out.append((best[1], best[2]))
                todo += [(a, best[1]), (best[2], b)]
        return sorted(out)

    r = random.Random(7)
    for _ in range(200):
        v = np.array([r.choice([-3.1, -1.3, -0.7, 1.17, 2.9]) + r.random() / 10 for _ in range(r.randrange(1, 25))])
        assert sorted((s, e) for s, e, _ in toxicity.segments(v)) == brute(v.tolist())
    assert toxicity.segments(np.array([-1.0])) == [] and toxicity.segments(np.zeros(0)) == []


def test_words_follow_the_class():
    import re

    r = random.Random(1)
    texts = ["".join(r.choice(" \t\n\x0b\x0c\ra\xa0é漢\x1cB") for _ in range(r.randrange(30))) for _ in range(300)] + ["", None]
    w = arrays.words(pa.array(texts, pa.large_string()).fill_null(""))
    want = [[m.encode() for m in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    got = [[w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first, w.first[1:], strict=False)]
    assert got == want
    hashes = arrays.span_hashes(w.data, w.starts, w.ends)
    flat = [x for t in want for x in t]
    assert len(set(hashes.tolist())) == len(set(flat)) and len({(h, x) for h, x in zip(hashes.tolist(), flat, strict=True)}) == len(set(flat))


def test_slices_keep_every_text():
    texts = pa.array(["a" * n for n in (5, 900, 3, 0, 50)] + [None])
    got = [t for _, part in arrays.slices(texts, 60) for t in part.to_pylist()]
    assert got == ["a" * n for n in (5, 900, 3, 0, 50, 0)]


def test_structured_words_have_hashes_of_their_own():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    w = arrays.words(pa.array([word + " " + other + " " + word], pa.large_string()))
    a, b, c = arrays.span_hashes(w.data, w.starts, w.ends).tolist()
    assert a == c != b


def test_leader_equals_plain_loop():
    """FTRL-proximal coordinate by coordinate, as its paper states it."""
    import math

    r = np.random.default_rng(3)
    rows = []
    for k in range(60):
        at = np.sort(r.choice(50, 8, replace=False))
        rows.append((at.astype(np.int32), r.random(8).astype(np.float32), int(at[0] % 2 == k % 2)))
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= quality.L1 and i != quality.BUCKETS:
            return 0.0
        return -(z.get(i, 0) - math.copysign(quality.L1, z.get(i, 0)) * (z.get(i, 0) != 0)) / ((quality.BETA + math.sqrt(n.get(i, 0))) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for at, value, label in rows:
            x = {**dict(zip(at.tolist(), map(float, value), strict=True)), quality.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0) + g - sigma * w[i], n.get(i, 0) + g * g
    weights, bias = quality.follow_leader(rows, passes=3)
    assert np.allclose(weights[:50], [weight(i) for i in range(50)], atol=1e-5) and abs(bias - weight(quality.BUCKETS)) < 1e-9


def test_scores_equal_plain_dot_products(spark, documents):
    weights = np.zeros(quality.BUCKETS, np.float32)
    texts = ["one two two", "", None, "a! b? a! 77 XY", "one two two"]
    w = arrays.words(pa.array(["one two two", "a! b? a! 77 XY"], pa.large_string()))
    bucket, text = quality.features(w)
    weights[bucket] = (bucket % 7 - 3) / 10
    got = {r["doc_id"]: r["score"] for r in quality.score_column(documents(*enumerate(texts)), weights, 0.25).collect()}
    plain = lambda i: 1 / (1 + np.exp(-(sum(float(weights[b]) for b, t in zip(bucket, text, strict=True) if t == i) / np.sqrt((text == i).sum()) + 0.25)))
    assert abs(got[0] - plain(0)) < 1e-6 and got[0] == got[4] and abs(got[3] - plain(1)) < 1e-6
    assert got[1] == got[2] == 1 / (1 + np.exp(-0.25))


def test_toxicity_equals_brute_force(spark, documents):
    """Token counts by Counter, segments by trying all, the evidence and the curve by their formulas."""
    import math
    from collections import Counter

    docs, labels = corpus(spark, documents, 300)
    sample = quality.labelled_sample(docs, labels, "toxic", 1000).cache()
    model = toxicity.learn(sample)
    strip = lambda t: [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for x in t.split()]
    of = lambda x: int(toxicity.tokens(arrays.words(pa.array([x], pa.large_string())))[0])
    counts, near = {0: Counter(), 1: Counter()}, {}
    for r in sample.collect():
        t = [of(x) for x in strip(r["text"] or "")]
        counts[r["label"]].update(t)
        for a, b in zip(t, t[1:], strict=False):
            if r["label"]:
                near.setdefault(b, set()).add(a & 63)
    total = {y: sum(counts[y].values()) for y in counts}
    prior = {b: toxicity.PRIOR * (counts[0][b] + counts[1][b]) for b in {**counts[0], **counts[1]}}
    whole = sum(prior.values())
    logit = lambda y, b: math.log((counts[y][b] + prior[b]) / (total[y] + whole - counts[y][b] - prior[b]))
    delta = {b: logit(1, b) - logit(0, b) for b in prior}
    z = {b: delta[b] / math.sqrt(1 / (counts[1][b] + prior[b]) + 1 / (counts[0][b] + prior[b])) for b in prior}
    kept = {b for b in prior if z[b] >= toxicity.LEAST_Z and len(near.get(b, ())) >= toxicity.LEAST_NEIGHBOURS and delta[b] > math.log(4)}
    middle = float(np.median([delta[b] for b in kept]))
    odds = {b: min(delta[b], middle) for b in kept}
    assert kept and set(np.flatnonzero(model.odds).tolist()) == kept
    assert all(abs(model.odds[b] - odds[b]) < 1e-5 for b in kept) and abs(model.decay + 0.35 * middle) < 1e-6

    def strength(text):
        v = [odds.get(b, 0.0) or model.decay for b in map(of, strip(text or ""))]
        parts, todo = [], [(0, len(v))]
        while todo:
            a, b = todo.pop()
            best = max(((sum(v[s:e]), s, e) for s in range(a, b) for e in range(s + 1, b + 1)), default=None)
            if best and best[0] > 0:
                parts.append(best[0])
                todo += [(a, best[1]), (best[2], b)]
        top = run = 0.0
        for k, x in enumerate(sorted((model.lam * x - math.log(len(v)) for x in parts), reverse=True), 1):
            if x <= 0:
                break
            run += x
            top = max(top, run + math.lgamma(k))
        return top

    some = docs.where("doc_id % 6 = 0 or doc_id >= 300 or doc_id is null")
    got = {r["doc_id"]: r["score"] for r in toxicity.detect(some, model).collect()}
    for r in some.collect():
        want = 1 / (1 + math.exp(-(model.slope * math.log1p(strength(r["text"])) + model.intercept)))
        assert abs(got[r["doc_id"]] - want) < 1e-4


@pytest.mark.parametrize("query", [quality.op2_quality, toxicity.op5_toxicity])
def test_repeated_and_missing_ids_and_clashing_names(spark, documents, folder, query):
    docs, labels = corpus(spark, documents, 60)
    more = documents((3, "another text of the same id"), (3, "another text of the same id"), (None, "no id"))
    clash = docs.unionByName(more).withColumn("score", docs.n_chars).withColumn("label", docs.n_chars).withColumn("held_out", docs.n_chars)
    rows = query(spark, folder(documents=clash, labels=labels)).collect()
    assert len(rows) == 65 and sum(r["doc_id"] == 3 for r in rows) == 3 and sum(r["doc_id"] is None for r in rows) == 1
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)


def test_the_bound_of_the_sample_holds_for_repeated_rows(spark, documents):
    docs = documents(*[(i % 3, f"text {i}") for i in range(50)], (7, None), (None, "x"))
    labels = spark.createDataFrame([(i, 1) for i in (0, 1, 2, 7)] + [(0, 0), (None, 1)], "doc_id bigint, toxic int")
    got = quality.labelled_sample(docs, labels, "toxic", 2).collect()
    assert 0 < len(got) <= 2 and len({r["doc_id"] for r in got}) == len(got)
    assert {(r["doc_id"], r["text"], r["label"]) for r in quality.labelled_sample(docs, labels, "toxic", 99).collect() if r["doc_id"] == 7} <= {(7, "", 1)}


def test_the_bound_of_the_rules_holds_for_repeated_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(rules, "TRAINING_ROWS", 2)
    docs = documents(*[(i % 3, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id bigint, quality int")
    assert rules.labelled_statistics(docs, labels).count() == 2
