import os
import threading

import pytest
from pyspark.sql import functions as F

from passagework.operators import lifecycle as life
from passagework.operators import versions

KV = "k int, v string"
REQUEST = "request_id int, event_key string, source_id string, title string, content string, target_id string, target_source string, expected_revision int, expected_proposal_revision int"
DECISION = "record_id string, expected_revision int, token string, state string, reviewer string"


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV)


def test_writers_of_other_rows_both_stay(spark, tmp_path, rows):
    t = str(tmp_path / "t")
    assert versions.latest(spark, t) == -1 and versions.snapshot(spark, t, "k", KV).count() == 0
    assert versions.commit(spark, t, kv(spark, (1, "a"), (2, "b")), "k", -1) == 0
    # two writers that both read version 0
    assert versions.commit(spark, t, kv(spark, (1, "x")), "k", 0) == 1
    assert versions.commit(spark, t, kv(spark, (3, "c")), "k", 0, gone=kv(spark, (2, ""))) == 2
    assert rows(versions.snapshot(spark, t, "k", KV)) == [(1, "x"), (3, "c")]
    assert rows(versions.snapshot(spark, t, "k", KV, 0)) == [(1, "a"), (2, "b")]
    assert versions.compacted(spark, t, "k", KV) == 3
    assert rows(versions.snapshot(spark, t, "k", KV)) == [(1, "x"), (3, "c")]


def test_a_conflict_leaves_no_trace(spark, tmp_path, rows):
    t = str(tmp_path / "t")
    versions.commit(spark, t, kv(spark, (1, "a"), (2, "b")), "k", -1)
    versions.commit(spark, t, kv(spark, (1, "x")), "k", 0)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, t, kv(spark, (1, "y")), "k", 0)
    with pytest.raises(versions.Conflict):  # it read what has changed
        versions.commit(spark, t, kv(spark, (9, "y")), "k", 0, read=kv(spark, (1, "")))
    assert rows(versions.snapshot(spark, t, "k", KV)) == [(1, "x"), (2, "b")] and versions.latest(spark, t) == 1


def test_the_loser_starts_again(spark, tmp_path, rows):
    t = str(tmp_path / "t")
    versions.commit(spark, t, kv(spark, (1, "a")), "k", -1)
    seen = []

    def add(name, between=lambda: None):
        def change(now):
            seen.append((name, now.first()["v"]))
            between()
            return now.withColumn("v", F.concat("v", F.lit(name)))

        return change

    first = iter([lambda: versions.update(spark, t, "k", KV, add("B")), lambda: None])
    assert versions.update(spark, t, "k", KV, add("A", lambda: next(first)())) == 2
    assert seen == [("A", "a"), ("B", "a"), ("A", "aB")]
    assert rows(versions.snapshot(spark, t, "k", KV)) == [(1, "aBA")]
    with pytest.raises(versions.Conflict):
        versions.update(spark, t, "k", KV, add("A", lambda: versions.update(spark, t, "k", KV, add("B"))), tries=1)


def test_one_of_many_gets_a_version(spark, tmp_path):
    path, told = f"{tmp_path}/log/1.json", []
    writers = [threading.Thread(target=lambda i=i: told.append((versions.put_if_absent(spark, path, str(i)), str(i)))) for i in range(12)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    winner = [i for won, i in told if won]
    assert len(winner) == 1 and open(path).read() == winner[0] and os.listdir(f"{tmp_path}/log") == ["1.json"]


def request(i, event, content, target=None, revision=None, own=None, source="s", target_source=None, title="t"):
    return (i, event, source, title, content, target, target_source, revision, own)


def test_from_proposal_to_acceptance(spark, tmp_path):
    t = str(tmp_path / "t")
    none = dict.fromkeys([c.split()[0] for c in life.RECORDS.split(", ")])
    old = [dict(none, record_id=r, source_id="s", revision=v, state=s, current=c, content=f"text {r}") for r, v, s, c in
           (("r1", 2, "accepted", True), ("r2", 1, "draft", True), ("r3", 1, "superseded", False), ("r4", 1, "imported", True))]
    versions.commit(spark, t, spark.createDataFrame(old, life.RECORDS), "record_id", -1)
    records = lambda: versions.snapshot(spark, t, "record_id", life.RECORDS)
    asks = [
        request(1, "e1", "new text", "r1", 2), request(2, "e2", "plain"), request(3, "e3", "x", "r1", 1), request(4, "e4", "x", "r9", 1), request(5, "e5", "x", "r2", 1), request(6, "e6", "x", "r3", 1),
        request(7, "e7", " "), request(8, "e8", "x", None, 1), request(9, "e9", "secret: hunter2hunter2"), request(10, "e2", "plain"), request(11, "e2", "other"), request(12, "e12", "x", "r1", 2, target_source="elsewhere"),
        request(13, "e13", "x", "r4", 1, target_source="s"), request(14, None, "x"),
    ]
    answers = {r["request_id"]: r["outcome"] for r in life.proposals(records(), spark.createDataFrame(asks, REQUEST)).collect()}
    assert answers == {
        1: "created", 2: "created", 3: "target_revision_changed", 4: "target_not_found", 5: "target_not_current", 6: "target_not_current", 7: "invalid_proposal", 8: "target_id_required", 9: "created", 10: "duplicate",
        11: "proposal_revision_changed", 12: "target_not_found", 13: "created", 14: "invalid_proposal"}
    life.propose(spark, t, spark.createDataFrame(asks, REQUEST))
    again = [request(1, "e1", "new text", "r1", 2), request(2, "e2", "better", own=1), request(3, "e9", "other", own=7), request(4, "e9", "x", source="z")]
    answers = {r["request_id"]: r["outcome"] for r in life.proposals(records(), spark.createDataFrame(again, REQUEST)).collect()}
    assert answers == {1: "duplicate", 2: "revised", 3: "proposal_revision_changed", 4: "event_of_another_source"}
    life.propose(spark, t, spark.createDataFrame(again, REQUEST))
    drafts = {r["title"] + r["content"]: r for r in records().where("event_key is not null").collect()}
    assert drafts["tbetter"]["revision"] == 2 and not any("hunter2" in c for c in drafts)
    reviews = {r["record_id"]: r for r in life.reviews(records()).collect()}
    correction = drafts["tnew text"]["record_id"]
    assert reviews[correction]["conflict"] is None and "-text r1" in reviews[correction]["diff"] and "+new text" in reviews[correction]["diff"]

    def decide(*rows):
        return spark.createDataFrame([(r, reviews[r]["revision"], reviews[r]["token"] if k is None else k, s, "me") for r, k, s in rows], DECISION)

    plain = drafts["tbetter"]["record_id"]
    told = life.finished(records(), decide((correction, None, "accepted"), (plain, "no", "accepted")).unionByName(spark.createDataFrame([("nobody", 1, "x", "accepted", "me")], DECISION)))[0]
    assert {r["record_id"]: r["outcome"] for r in told.collect()} == {correction: "done", plain: "proposal_changed_since_review", "nobody": "not_found"}
    rebuilt = []
    life.finish(spark, t, decide((correction, None, "accepted")), lambda df, version: rebuilt.append((df.count(), version)))
    now = {r["record_id"]: r for r in records().collect()}
    assert rebuilt == [(len(now), 3)]
    assert (now[correction]["state"], now[correction]["revision"], now[correction]["reviewed_by"]) == ("accepted", 3, "me")
    assert (now["r1"]["state"], now["r1"]["current"], now["r1"]["superseded_by"]) == ("superseded", False, correction)
    told = life.finished(records(), decide((correction, None, "accepted"), (plain, None, "accepted"), (plain, None, "rejected")))[0]
    assert {r["record_id"]: r["outcome"] for r in told.collect()} == {correction: "duplicate", plain: "contradictory"}
    assert life.finished(records(), decide((correction, None, "rejected")))[0].first()["outcome"] == "proposal_already_reviewed"


def test_two_proposers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    t = str(tmp_path / "t")
    first, second = (spark.createDataFrame([request(1, "shared", text), request(2, text, text)], REQUEST) for text in ("one", "two"))
    real, hook = life.proposals, [lambda: life.propose(spark, t, second)]

    def interleaved(records, requests):
        if hook:
            hook.pop()()
        return real(records, requests)

    monkeypatch.setattr(life, "proposals", interleaved)
    life.propose(spark, t, first)
    found = versions.snapshot(spark, t, "record_id", life.RECORDS).select("event_key", "content", "revision").collect()
    assert sorted(map(tuple, found)) == [("one", "one", 1), ("shared", "two", 1), ("two", "two", 1)]


def test_catalog(spark, rows):
    entries = spark.createDataFrame([("a", "s", "a.md", "1"), ("b", "s", "b.md", "2"), ("c", "s", "c.md", "3"), ("d", "s", "d.md", "4"), ("e", "s", "e.md", "4")], "record_id string, source_id string, path string, digest string")
    live = spark.createDataFrame([("s", "a.md", "1"), ("s", "b.md", "9"), ("s", "x/c.md", "3"), ("s", "x/d.md", "4"), ("z", "n.md", "7")], "source_id string, path string, digest string")
    claims = spark.createDataFrame([("k1", "a", None, None), ("k2", "b", None, None), ("k3", "b", None, None)], "claim_id string, target_id string, target_path string, target_digest string")
    got = rows(life.catalog(entries, live, claims).where("presence <> 'imported'").select("record_id", "path", "digest", "presence", "state", "superseded_by", "current"))
    assert got == [("a", "a.md", "1", "present", "corrected", "k1", False), ("b", "b.md", "9", "changed", "conflict", None, True), ("c", "x/c.md", "3", "moved", "accepted", None, True),
                   ("d", "d.md", "4", "missing", "accepted", None, True), ("e", "e.md", "4", "missing", "accepted", None, True)]
    assert rows(life.catalog(entries, live, claims).where("presence = 'imported'").select("source_id", "path")) == [("s", "x/d.md"), ("z", "n.md")]
