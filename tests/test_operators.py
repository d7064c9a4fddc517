import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from passagework.functions import records, text, timeframe
from passagework.operators import links, passages, ranking, review, sync, threads, topics, vectors
from passagework.plans.recall import Budget, about_topic, chunked, described, listing, recall, recall_in_time, servable, visible
from passagework.queries import search
from passagework.sources import notes, transcripts


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_windows_stop_at_the_end(spark, rows):
    d = spark.createDataFrame([(1, "a" * 1100), (2, "b" * 1101), (3, ""), (4, None)], "k int, text string")
    assert [(r[0], r[1], len(r[2])) for r in rows(passages.windows(d))] == [(1, 0, 1100), (2, 0, 1100), (2, 1, 151)]
    with pytest.raises(ValueError):
        passages.windows(d, size=10, overlap=10)


def test_sections(spark, rows):
    d = spark.createDataFrame([(1, "intro\n# One\na\nb\n## Two\n\n## Three\nc"), (1, "intro\n# One\na\nb\n## Two\n\n## Three\nc"), (2, None), (3, "# only\n"), (4, "#no heading\n #also no")], "line int, text string")
    one_note = [(1, 0, "body", "intro"), (1, 1, "One", "a\nb"), (1, 3, "Three", "c")]
    assert rows(passages.sections(d)) == sorted([*one_note, *one_note, (4, 0, "body", "#no heading\n #also no")], key=repr)


def test_passages_say_where_they_come_from(spark, rows):
    d = spark.createDataFrame([(1, "T", "sum", "intro\n# One\n" + "a" * 1200), (2, "U", None, "")], "k int, title string, summary string, body string")
    got = passages.passages_of(d).orderBy("k", "chunk_no").collect()
    assert [(r["chunk_no"], r["heading"], r["text"][:9], len(r["text"])) for r in got] == [(0, "summary", "T - sum", 7), (1, "body", "T\nintro", 7), (2, "One", "T > One\na", 1108), (3, "One", "T > One\na", 258)]


def test_mask_is_each_pattern_in_order(spark):
    draw = np.random.default_rng(5)
    parts = ["sk-abcdefghijklmnop1", "BEARER abcdefghijkl", "xoxb-12345678", "ghp_" + "a" * 20, "ASIA0123456789AB", "AIza" + "b" * 20, "eyJ" + "c" * 20, "PassWord = x", "API_KEY:y", "api-key=z", "tOKEN : sk-" + "d" * 16, "-----BEGIN RSA PRIVATE KEY-----", "İI key", "ordinary words", "sk-", "secret", "\n"]
    texts = [" ".join(draw.choice(parts, 4)) for _ in range(150)] + ["", None, *parts]
    x = F.col("x")
    want, kinds = x, []
    for kind, pattern in text.SECRETS:
        kinds.append(F.when(want.rlike(pattern), F.lit(kind)))
        want = F.regexp_replace(want, pattern, text.MASK)
    d = spark.createDataFrame([(t,) for t in texts], "x string").select(text.masked(x).alias("m"), text.mask_kinds(x).alias("k"), want.alias("wm"), F.array_compact(F.array(*kinds)).alias("wk"))
    found = d.collect()
    assert all(r["m"] == r["wm"] and r["k"] == r["wk"] for r in found) and len({k for r in found for k in r["k"]}) == len(text.SECRETS)
    once = search.mask_secrets(spark, "/root/testdata/sf0.001")
    assert once._jdf.queryExecution().analyzed().toString().count("regexp_replace") == len(text.SECRETS)


def test_mask(spark):
    x = F.col("x")
    got = one(spark, F.struct(text.masked(x), text.mask_kinds(x)), "key sk-abcdefghijklmnop1 and token = abc AKIAABCDEFGHIJKL")
    assert got[0] == "key ***MASKED*** and ***MASKED*** ***MASKED***" and got[1] == ["openai_key", "aws", "assignment"]


def test_small_text_functions(spark):
    x = F.col("x")
    assert one(spark, text.slug(x), "  Hello, World! of  things ") == "hello-world-of-things"
    assert one(spark, text.person(x), " Ayşe  ÖZ") == "ayse oz"
    assert one(spark, text.same_person(x, F.lit("Ercan Demir")), "Can") is False
    assert one(spark, text.same_person(x, F.lit("Can Demir")), "Can") is True
    assert one(spark, text.shortened(x, 8), "one two three") == "one two …"
    assert one(spark, text.clock(F.lit(3725)), "") == "1:02:05" and one(spark, text.clock(F.lit(65)), "") == "1:05"
    assert one(spark, text.decision_of(x), "- [x] done") == "accepted"
    assert one(spark, threads.collapsed(x), "well no no no no no no no then") == "well no then"
    assert one(spark, threads.collapsed(x), "no no yes") == "no no yes"


@pytest.mark.parametrize(("question", "start", "end"), [
    ("what happened yesterday", "2026-09-26", "2026-09-26"),
    ("notes of the last 3 days", "2026-09-25", "2026-09-27"),
    ("last week", "2026-09-14", "2026-09-20"),
    ("geçen ay ne oldu", "2026-08-01", "2026-08-31"),
    ("plans in october", "2025-10-01", "2025-10-31"),
    ("what about 2026-03-04", "2026-03-04", "2026-03-04"),
    ("5 march", "2026-03-05", "2026-03-05"),
    ("5 december", "2025-12-05", "2025-12-05"),
    ("may 2024", "2024-05-01", "2024-05-31"),
    ("mayıs ayında", "2026-05-01", "2026-05-31"),
    ("eylul ayinda ne yaptik", "2026-09-01", "2026-09-30"),
    ("12 kasim", "2025-11-12", "2025-11-12"),
    ("son 3 hafta özet", "2026-09-07", "2026-09-27"),
    ("son iki ay", "2026-07-30", "2026-09-27"),
    ("Eylül'de", "2026-09-01", "2026-09-30"),
    ("day before yesterday", "2026-09-25", "2026-09-25"),
    ("bu yıl", "2026-01-01", "2026-09-27"),
])
def test_time_phrases(question, start, end):
    got = timeframe.parse(question, dt.date(2026, 9, 27))
    assert (str(got.start), str(got.end)) == (start, end)


def test_no_time():
    assert timeframe.parse("october milestone", dt.date(2026, 9, 27)) is None
    assert timeframe.parse("2026-02-31", dt.date(2026, 9, 27)) is None
    got = timeframe.parse("budget of last week", dt.date(2026, 9, 27))
    assert got.residual == "budget of" and not got.activity
    today = dt.date(2026, 9, 27)
    for asks in ("what did we do yesterday", "decisions made last week", "son 3 hafta özet", "Eylül'de neler oldu?"):
        assert timeframe.parse(asks, today).activity, asks
    assert not timeframe.parse("why did the bill double in July?", today).activity and timeframe.parse("March or in July", today) is None
    say = lambda a, b: timeframe.Timeframe(a, b, "", "", True).label()
    assert say(today, today) == "27 September 2026" and say(dt.date(2026, 9, 1), today) == "1–27 September 2026" and say(dt.date(2025, 12, 31), dt.date(2026, 1, 2)) == "31 December 2025 – 2 January 2026"


def test_passage_dates(spark):
    none, day = F.lit(None).cast("string"), F.lit(dt.date(2024, 1, 9))
    of = lambda heading, path, made=none, frame=None: one(spark, timeframe.passage_date(F.lit(heading), F.lit(path), [made], day, frame), "")
    assert str(of("2025-02-03 talk", "a.md")) == "2025-02-03" and str(of("talk", "2025-01-01 x/a.md")) == "2024-01-09"
    assert str(of("talk", "x/2025-03-04 a.md", F.lit("2025-05-06"))) == "2025-03-04"
    frame = timeframe.Timeframe(dt.date(2025, 5, 1), dt.date(2025, 5, 31), "", "", True)
    assert str(of("talk", "x/2025-03-04 a.md", F.lit("2025-05-06"), frame)) == "2025-05-06"


def test_budget_fold(spark, rows):
    d = spark.createDataFrame([(1, 1, "a", "x" * 60), (1, 2, "a", "x  x"), (1, 3, "a", "no room in the document"), (1, 4, "b", "y" * 90), (1, 5, "b", "short")], "q int, rank int, doc string, text string")
    got = ranking.within_budget(d, "q", "rank", "doc", "text", 6, 100, 2)
    assert [(r[1], r[2], r[3]) for r in rows(got)] == [(1, 1, "a"), (2, 2, "a"), (3, 5, "b")]
    cut = ranking.within_budget(d, "q", "rank", "doc", "text", 1, 50, 2).first()
    assert len(cut["shown"]) == 50 and cut["truncated"]
    for wrong in ({"top_k": True}, {"max_chars": 0}, {"max_chars": 2.0}, {"other": 1}):
        with pytest.raises(ValueError):
            Budget().lowered(**wrong)
    assert Budget(top_k=6).lowered(top_k=9, max_chars=500) == Budget(6, 500, 2) and Budget(top_k=99).lowered().top_k == 20


def test_bm25_repeats_count_twice(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green dog"), (4, "cat")], "k int, text string")
    q = spark.createDataFrame([(1, "red"), (2, "red red")], "q int, text string")
    got = {r["q"]: r["score"] for r in passages.bm25(d, ["k"], "text", passages.query_terms(q, "q", "text"), "q").collect()}
    assert got[2] == pytest.approx(2 * got[1]) and got[1] > 0


@pytest.mark.parametrize("few", [True, False])
def test_stems_match_longer_words(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(passages, "ASKED_TERMS", 1)
    d = spark.createDataFrame([(1, "kurulumu bitti"), (2, "kurul toplandı"), (3, "kurulumlar kurulum"), (4, None), (5, "x y")], "k int, text string")
    q = spark.createDataFrame([(1, "kurulum bitti")], "q int, text string")
    hits = {(r["k"], r["term"]): (r["tf"], r["len"]) for r in passages.term_hits(d.where("text is not null"), ["k"], "text", passages.query_terms(q, "q", "text", prefixes=True)).collect()}
    assert hits == {(1, "kuru*"): (1, 2), (1, "bitti"): (1, 2), (1, "bitt*"): (1, 2), (2, "kuru*"): (1, 2), (3, "kuru*"): (2, 2), (3, "kurulum"): (1, 2)}


def test_recall_finds_the_dated_fact(spark):
    docs = spark.createDataFrame([
        ("p", "maple.md", "Maple", "The maple bridge opens in spring with two lanes."), ("p", "birch.md", "Birch", "The birch tower is under review."),
        ("t", "other.md", "Other", "Lunch menus for the team."), ("t", "more.md", "More", "Parking rules apply to everyone."),
    ], "source_id string, path string, title string, body string")
    index = chunked(docs)
    ask = spark.createDataFrame([("q", "when does the maple bridge open")], "qid string, question string")
    assert recall(index, ask).orderBy("place").first()["citation"] == "Maple (p:maple.md)"
    assert recall(index, ask, sources=[]).count() == 0
    assert {r["citation"] for r in recall(index, ask, sources=["t"]).collect()} <= {"Other (t:other.md)", "More (t:more.md)"}
    none = F.lit(None).cast("string")
    files = docs.select("source_id", "path", F.lit("note").alias("kind"), F.lit("accepted").alias("state"), F.lit(True).alias("current"), F.when(F.col("path") == "birch.md", "2026-09-26").otherwise("2026-01-01").alias("created"), none.alias("dated"), none.alias("updated"), none.cast("date").alias("committed"))
    today = dt.date(2026, 9, 27)
    listed = recall_in_time(index, files, "what did we do yesterday", today).collect()
    assert [r["citation"] for r in listed] == ["Birch (p:birch.md)"] and listed[0]["in_range"]
    got = recall_in_time(index, files, "the maple bridge or tower yesterday", today).orderBy("place").collect()
    assert (got[0]["citation"], got[0]["in_range"]) == ("Birch (p:birch.md)", True) and (got[1]["citation"], got[1]["in_range"]) == ("Maple (p:maple.md)", False)
    assert recall_in_time(index, files, "zebra yesterday", today).count() == 0
    assert recall(index, ask, gate=lambda rows: rows.where("path = 'more.md'").select("qid", "chunk_id", "rank")).count() == 0
    variants = spark.createDataFrame([("q", 1, "lunch menus"), ("q", 2, " ")], "qid string, variant int, question string")
    assert {r["path"] for r in recall(index, ask, variants=variants).collect()} >= {"maple.md", "other.md"}
    about = described(recall(index, ask), files).orderBy("place").first()
    assert (str(about["date"]), about["state"], about["current"]) == ("2026-01-01", "accepted", True)
    assert servable(files.withColumn("pending", F.lit(False)).withColumn("state", F.when(F.col("path") == "more.md", "rejected").otherwise("draft"))).count() == 0
    assert visible(["a"], None) == ["a"] and visible(None, ["a", "a"]) == ["a"]
    for asked, scope in ((None, []), (["b"], ["a"])):
        with pytest.raises(ValueError):
            visible(asked, scope)


def test_listing_hides_raw_notes_of_written_days(spark, rows):
    day = dt.date(2026, 9, 26)
    d = spark.createDataFrame([
        ("a#1", "s", "a.md", "A", "body", "x", "note", day), ("a#2", "s", "a.md", "A", "2026-09-26", "y", "note", day), ("b#1", "s", "b.md", "B", "body", "raw", "chat-raw", day), ("c#1", "s", "c.md", "C", "summary", "z " * 400, "clip", dt.date(2026, 9, 25)),
    ], "chunk_id string, source_id string, path string, title string, heading string, text string, kind string, day date")
    got = listing(d).orderBy("rank").collect()
    assert [(r["path"], r["heading"], r["truncated"]) for r in got] == [("a.md", "2026-09-26", False), ("c.md", "summary", True)] and len(got[1]["text"]) <= 602
    assert [r["chunk_id"] for r in about_topic(d, "about zzz A yyy").collect()] == []
    assert [r["chunk_id"] for r in about_topic(d.withColumn("title", F.lit("Yearly plan")), "the yearly plans").orderBy("chunk_id").collect()] == ["a#1", "a#2", "b#1", "c#1"]


def test_echo(spark, rows):
    lines = spark.createDataFrame([
        (1, 1, 0.0, "others", "we ship the new build on friday"), (1, 2, 4.0, "me", "ship the new build friday"), (1, 3, 2.0, "me", "new build"),
        (1, 4, 3.0, "me", "yes"), (1, 5, 30.0, "me", "ship the new build friday"),
    ], "meeting int, n int, start double, speaker string, text string")
    assert [r[1] for r in rows(threads.without_echo(lines))] == [1, 4, 5]


def test_exchanges_and_packing(spark, rows):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "d")], "conv_id int, turn int, role string, text string")
    assert rows(threads.exchanges(t)) == [(1, 1, "a", "c"), (1, 2, "d", "")]
    p = spark.createDataFrame([(1, i, n) for i, n in enumerate([30, 80, 20, 200, 10])], "g int, o int, n int")
    assert [r[2] for r in rows(threads.packed(p, "g", "o", F.col("n"), 100))] == [0, 1, 1, 2, 3]


def test_later_context_keeps_what_the_owner_settles(spark, rows):
    x = spark.createDataFrame([
        (1, 1, "ship it?", "Maybe."), (1, 2, "No, we dropped that.", "Understood"), (1, 3, "o" * 500, "Weather is fine. The pilot rollout moved\nNow it is closed. Bye! Nothing else."), (1, 4, None, "Launcher ready. So what?  \n Pilot alone. Rollout alone."),
    ], "conv_id int, i int, user string, assistant string")
    items = spark.createDataFrame([(7, 1, 1, "The pilot ships", "a rollout", ["launch"]), (8, 1, 3, "x", "y", None)], "item_id int, conv_id int, exchange int, statement string, quote string, keywords array<string>")
    got = [(7, 2, "No, we dropped that.", ""), (7, 3, "o" * 400, "The pilot rollout moved Now it is closed."), (7, 4, "", "Launcher ready. So what?"), (8, 4, "", "")]
    assert rows(threads.later_context(items, x).select("item_id", "i", "owner", "assistant")) == got
    assert rows(threads.later_context(items, x, 24 + 441).select("item_id", "i", "size", "running")) == [(7, 3, 441, 465), (7, 4, 24, 24), (8, 4, 0, 0)]
    assert rows(threads.later_context(items, x, 464).select("item_id", "i")) == [(7, 4), (8, 4)]


def test_links(spark, rows):
    n = spark.createDataFrame([("a.md", "see [[Plan#x|the plan]] and [b](sub/b%20c.md) not [w](https://x.org/y.md) ![i](i.md)")], "path string, body string")
    assert rows(links.note_links(n, "path", "body").select("href")) == [("Plan",), ("sub/b c.md",)]
    got = links.resolved(spark.createDataFrame([("q", "b.md"), ("q", "x/b.md"), ("q", "none")], "page string, href string"), spark.createDataFrame([("z/y/b.md",), ("x/b.md",)], "path string"))
    assert rows(got.select("href", "target")) == [("b.md", "x/b.md"), ("x/b.md", "x/b.md")]


def test_links_resolve_in_four_steps(spark, rows):
    targets = spark.createDataFrame([(p,) for p in ("Plan.md", "a/b.md", "p/q/x/b.md", "x/c.md", "y/c.md", "y/z/d.md", "k/y/z/d.md", "w/é.md", "e", "e.md")], "path string")
    asked = [
        ("n.md", "Plan", "Plan.md"), ("n.md", " Plan.md ", "Plan.md"), ("n.md", "x/b.md", "p/q/x/b.md"), ("n.md", "b", "a/b.md"), ("y/n.md", "c", "y/c.md"), ("n.md", "c", "x/c.md"), ("y/n.md", "../x/c", "x/c.md"),
        ("y/z/n.md", ".././c.md", "y/c.md"), ("n.md", "z/d", "y/z/d.md"), ("n.md", "/x/c/", "x/c.md"), ("n.md", "e", "e.md"), ("n.md", "é", "w/é.md"), ("n.md", "z/b", None), ("n.md", "../Plan", None), ("n.md", "/", None), ("n.md", ".md", None),
    ]
    got = links.resolved(spark.createDataFrame([x[:2] for x in asked], "page string, href string"), targets, "page")
    assert rows(got) == sorted((x for x in asked if x[2]), key=repr)
    n = spark.createDataFrame([("x/n.md", "[c](c.md) [up](../y/c.md) [root](/a/b.md) [out](../../c.md) [[Plan]]")], "path string, body string")
    found = links.note_links(n, "path", "body")
    assert rows(found.select("href")) == [("Plan",), ("a/b.md",), ("x/c.md",), ("y/c.md",)]
    assert rows(links.resolved(found, targets, "path").select("target")) == [("Plan.md",), ("a/b.md",), ("x/c.md",), ("y/c.md",)]


def test_renames(spark, rows):
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "2"), ("s", "k", "3")], "source_id string, path string, digest string")
    new = spark.createDataFrame([("s", "x", "1"), ("s", "y", "2"), ("s", "k", "3")], "source_id string, path string, digest string")
    assert [(r["digest"], r["verdict"]) for r in sync.renames(old, new).orderBy("digest").collect()] == [("1", "moved"), ("2", "ambiguous")]


def test_publish(spark, tmp_path):
    sync.publish(spark.range(3), str(tmp_path), 1)
    sync.publish(spark.range(5), str(tmp_path), 2)
    assert sync.read_current(spark, str(tmp_path)).count() == 5
    with pytest.raises(ValueError):
        sync.publish(spark.range(7), str(tmp_path), 3, lambda df: df.count() < 7)
    with pytest.raises(AnalysisException):
        sync.publish(spark.range(1), str(tmp_path), 2)
    assert sync.read_current(spark, str(tmp_path)).count() == 5


def test_nearest_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id_ long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:3]}
    assert {(r["query_id"], r["id_"]) for r in vectors.nearest(d, d, "id_", "v", 3).collect()} == want


@pytest.mark.parametrize("block", [10, 2000])
def test_nearest_in_tiles_with_copies_and_ties(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    m = np.repeat(rng.normal(size=(40, 5)), [8, 3] + [2] * 38, axis=0)
    ids = rng.permutation(len(m))
    ids[3] = ids[4]  # an id twice is never its own neighbour
    for name, value in (("BLOCK", block), ("ASKED_CELLS", 100), ("ROW_CELLS", 150), ("TILE", (7, 9))):
        monkeypatch.setattr(vectors, name, value)
    d = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id_ long, v array<double>").repartition(3)
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    scores = np.round(u @ u.T, 10)
    want = {}
    for q in set(ids.tolist()) - {int(ids[3])}:
        at = int(np.flatnonzero(ids == q)[0])
        rest = sorted((-s, int(i)) for s, i in zip(scores[at], ids) if i != q)
        want |= {(q, k + 1): i for k, (_, i) in enumerate(rest[:4])}
    got = vectors.nearest(d.where(F.col("id_") != int(ids[3])), d, "id_", "v", 4)
    assert {(r["query_id"], r["rank"]): r["id_"] for r in got.collect()} == want
    twice = vectors.nearest(d, d, "id_", "v", 4).where(F.col("query_id") == F.col("id_"))
    assert twice.count() == 0


def test_hashed_vector():
    golden = vectors.hashed_vector("Alpha beta b", 16)  # "b" is too short; each word's slot and sign come from its own hash
    want = np.zeros(16)
    for word in ("alpha", "beta"):
        h = hashlib.blake2b(word.encode(), digest_size=8).digest()
        want[int.from_bytes(h[:4], "big") % 16] += 1 if h[4] % 2 == 1 else -1
    assert np.allclose(golden, want / np.linalg.norm(want)) and np.count_nonzero(golden) in (1, 2)
    assert vectors.hashed_vector("", 16)[0] == 1.0
    assert np.linalg.norm(vectors.hashed_vector("some words here", 16)) == pytest.approx(1)


def test_two_communities(spark):
    pairs = [(i, j, 1.0) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(0, 10, 0.1)]
    got = {r["node"]: r["community"] for r in topics.communities(spark.createDataFrame(pairs, "a long, b long, weight double")).collect()}
    assert {got[i] for i in range(5)} == {0} and {got[i] for i in range(10, 15)} == {10}
    labels = spark.createDataFrame([(i, 0 if i < 10 else 10) for i in got], "node long, community long")
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    total, degree = sum(w for *_, w in pairs), {}
    for a, b, w in pairs:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    same = lambda a, b: (a < 10) == (b < 10)
    want = sum(w for a, b, w in pairs if same(a, b)) / total - sum(degree[a] * degree[b] for a in degree for b in degree if same(a, b)) / (4 * total * total)
    assert topics.modularity(edges, labels) == pytest.approx(want)


def _moves_by_hand(pairs, odd):
    """Labels, rounds and levels of the moves that topics.communities documents, one node after another."""
    graph, names, rounds, levels = {}, {}, 0, 0
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            graph[x, y], names[x] = graph.get((x, y), 0.0) + w, x
    total = sum(graph.values())
    while True:
        k, levels, r, idle, moved = {}, levels + 1, 0, 0, False
        for (a, _), w in graph.items():
            k[a] = k.get(a, 0.0) + w

        def weighed(lab):
            tot, pull = {}, {a: {lab[a]: 0.0} for a in k}
            for a in k:
                tot[lab[a]] = tot.get(lab[a], 0.0) + k[a]
            for (a, b), w in graph.items():
                if a != b:
                    pull[a][lab[b]] = pull[a].get(lab[b], 0.0) + w
            to = {a: min(pull[a], key=lambda c: (-round(pull[a][c] - k[a] * (tot[c] - (k[a] if c == lab[a] else 0.0)) / total, 10), c != lab[a], c)) for a in k}
            return sum(w for (a, b), w in graph.items() if lab[a] == lab[b]) / total - sum(x * x for x in tot.values()) / total**2, to

        lab = {a: a for a in k}
        best, to = weighed(lab)
        while idle < 2:
            after = {a: to[a] if odd[a] == r % 2 else c for a, c in lab.items()}
            q, there = weighed(after)
            if q > best + 1e-12:
                lab, best, to, idle, moved = after, q, there, 0, True
            else:
                idle += 1
            r, rounds = r + 1, rounds + 1
        if not moved:
            least = {c: min(x for x in names if names[x] == c) for c in set(names.values())}
            return {x: least[c] for x, c in names.items()}, rounds, levels
        names, merged = {x: lab[c] for x, c in names.items()}, {}
        for (a, b), w in graph.items():
            merged[lab[a], lab[b]] = merged.get((lab[a], lab[b]), 0.0) + w
        graph = merged


def test_a_round_of_moves_is_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 40, (2, 90)), rng.random(90).round(4))] + [(3, 3, 0.5), (1, 2, 0.25), (2, 1, 0.25)]
    odd = {r[0]: r[1] for r in spark.range(40).select("id", F.pmod(F.xxhash64("id"), F.lit(2))).collect()}
    want, rounds, levels = _moves_by_hand(pairs, odd)
    passes, write, frame = [], topics.written, type(spark.range(0))
    monkeypatch.setattr(topics, "written", lambda df: (passes.append("table"), write(df))[1])
    for name in ("first", "count"):
        monkeypatch.setattr(frame, name, lambda df, name=name, action=getattr(frame, name): (passes.append(name), action(df))[1])
    found = topics.communities(spark.createDataFrame(pairs, "a long, b long, weight double"))
    monkeypatch.undo()
    assert levels > 2 and {r["node"]: r["community"] for r in found.collect()} == want
    # besides the rounds, a level writes its degrees, its edges, its first labels, and where they meet the nodes and the next level
    assert len(passes) <= rounds + 5 * levels, (len(passes), rounds, levels)
    nothing = topics.communities(spark.createDataFrame([], "a long, b long, weight double"))
    assert nothing.count() == 0 and nothing.columns == ["node", "community"]


def test_front_matter_shapes():
    f, body = notes.front_matter('---\ntitle: "A"\ntags: [x, "y, z"]\nverified:\n  - by: human:a\n    at: 2026-01-01\n  - by: bot\non: on\nmap: {a: 1, b: two}\n---\nbody\n')
    assert f == {"title": "A", "tags": ["x", "y, z"], "verified": [{"by": "human:a", "at": "2026-01-01"}, {"by": "bot"}], "on": True, "map": {"a": 1, "b": "two"}}
    assert body == "body\n"
    f, _ = notes.front_matter('---\r\ns: "a \\"b\\" \\u00e9"\r\nodd line\r\nq: \'it\'\'s\'\r\nn: -3\r\nx: 1.5\r\nlist:\r\n- a\r\n- {k: [1, two]}\r\nempty:\r\ndeep:\r\n  in:\r\n    k: v\r\n  odd\r\n  more: yes # said\r\n---\r\nb')
    assert f == {"s": 'a "b" é', "q": "it's", "n": -3, "x": 1.5, "list": ["a", {"k": [1, "two"]}], "empty": None, "deep": {"in": {"k": "v"}, "more": True}}
    assert notes.scalar("[a, [b], 'c, d'") == "[a, [b], 'c, d'" and notes.scalar("{}") == {} and notes.scalar("~") is None
    assert notes.front_matter("---\n: bad\n---\nkept")[1] == "kept" and notes.front_matter("plain") == ({}, "plain")


def test_records(spark):
    x = F.col("x")
    assert tuple(one(spark, records.lifecycle(x, F.lit(None).cast("string")), "Draft")) == ("draft", True)
    assert tuple(one(spark, records.lifecycle(x, F.lit(None).cast("string")), "wip")) == ("stable", False)
    assert one(spark, records.trust(F.array(x)), "human:a") == "human-reviewed"
    assert one(spark, records.stale(x, F.lit(None).cast("string"), F.lit("2026-01-02").cast("timestamp")), "2026-01-01") is True


def test_notes_and_archives(spark, tmp_path, rows):
    import io
    import tarfile

    (tmp_path / "n" / ".git").mkdir(parents=True)
    (tmp_path / "n" / "a.md").write_text("---\ntitle: T\n---\nhello")
    (tmp_path / "n" / ".git" / "b.md").write_text("no")
    got = notes.titles(notes.parsed(notes.read_notes(spark, str(tmp_path / "n"), "s")))
    assert rows(got.select("path", "title", "body")) == [("a.md", "T", "hello")]
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        for name in ("r/ok.md", "r/../bad.md", "r/skip.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    assert rows(notes.read_archives(spark, str(tmp_path)).select("path", "content")) == [("ok.md", "hi")]


def test_question_set(spark, rows):
    d = spark.createDataFrame([("| id | question | answerable | expected | ok |",), ("| q1 | a \\| b? | yes | [[x]] | [x] |",), ("text",)], "value string")
    assert rows(notes.question_set(d)) == [("q1", "a | b?", "yes", "[[x]]", True)]


def test_transcripts(spark, tmp_path, rows):
    (tmp_path / "t1.jsonl").write_text("\n".join([
        '{"type":"user","message":{"role":"user","content":"hi <system-reminder>x</system-reminder>"}}', '{"type":"assistant","message":{"content":[{"type":"text","text":"yo"},{"type":"tool_use","name":"t"}]}}',
        '{"type":"user","isMeta":true,"message":{"content":"meta"}}', '{"type":"title","title":"one"}', '{"type":"title","title":"two"}',
    ]))
    lines = transcripts.read_lines(spark, str(tmp_path))
    assert [r[2:4] for r in rows(transcripts.turns(lines))] == [("user", "hi"), ("assistant", "yo")]
    assert rows(transcripts.titled(lines, ["title"])) == [("t1", "two")]
    n = spark.createDataFrame([("m.md", "## T\n- **[1 · 0:05] me:** hello\n- **[2 · 1:00:01] others:** bye")], "path string, body string")
    assert rows(transcripts.meeting_lines(n)) == [("m.md", 1, 5.0, "me", "hello"), ("m.md", 2, 3601.0, "others", "bye")]


def test_cards(spark):
    cards = spark.createDataFrame([("c1", 7, "A", None, "x"), ("c2", 8, "B", None, "y"), ("c3", 8, "C", None, "z")], "code string, number int, title string, due string, touched string")
    others = spark.createDataFrame([("note", 1, "see /c/c2"), ("chat", 2, "about #7"), ("chat", 3, "about #8")], "origin string, id int, text string")
    got = {(r["code"], tuple(r["badges"])) for r in review.merged_cards(cards, others).collect()}
    assert got == {("c1", ("card", "chat")), ("c2", ("card", "note")), ("c3", ("card",)), (None, ("chat",))}


def test_block_scalars_and_comments_behind_quotes():
    front, body = notes.front_matter(
        "---\nm: |\n  one\n   two: x\n\n  # no comment\n  - three\n\nf: >-  # folded\n  a\n  b\n\n  c\n    d\n  e\nk: |+\n  x\n\n\nn: 'x' # c\nq: \"a # b\"   # c\nl: [1, '#2'] # d\nh: 'a'b # e\n"
        "items:\n  - |-\n    p\n    q\n  - key: >\n      r\n      s\n    more: t\n  - u\nd: |2\n    two more\n  base\nempty: |\nlast: 'it''s' #\n---\nbody")
    assert front == {
        "m": "one\n two: x\n\n# no comment\n- three\n", "f": "a b\nc\n  d\ne", "k": "x\n\n\n", "n": "x", "q": "a # b", "l": [1, "#2"], "h": "'a'b # e", "items": ["p\nq", {"key": "r s\n", "more": "t"}, "u"],
        "d": "  two more\nbase\n", "empty": "", "last": "it's"}
    assert body == "body"
    assert notes.front_matter("---\nt: >\n  a\n\n\n  b\n  c\n---\n")[0] == {"t": "a\n\nb c\n"}
    assert notes.front_matter("---\nt: >\n\n  a\n---\n")[0] == {"t": "\na\n"}
    assert notes.front_matter("---\nt: |-\n  end\n---\n")[0] == {"t": "end"}
