"""Records from proposal to decision: the live catalog, proposals that retry safely, reviews with a token, and what acceptance changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import masked
from passagework.operators import ledger, sync, versions

#: A record's columns in a versioned table.
RECORDS = (
    "record_id string, source_id string, revision int, state string, current boolean, title string, content string, event_key string, request_hash string, "
    "target_id string, target_source string, target_revision int, target_digest string, review_token string, reviewed_by string, superseded_by string"
)
#: Longest text of a proposal and of its title.
MOST_CONTENT, MOST_TITLE = 20_000, 200


def digest(content: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")), 256)


def catalog(entries: DataFrame, live: DataFrame, claims: DataFrame) -> DataFrame:
    """(record_id, source_id, path, digest, presence, state, superseded_by, current): every known record and every live file once.

    entries (record_id, source_id, path, digest) are what is known, live (source_id, path, digest) what is there now. A
    record is present, changed, moved (its digest is gone at one path and fresh at one other of its source) or missing;
    a live file that no record accounts for is imported under an id of its source and path. claims are corrections, as
    in sync.corrections: a record under one is superseded by it, under several in conflict and unchanged.
    """
    moves = sync.renames(entries, live).where("verdict = 'moved'").select("source_id", F.col("old_path").alias("path"), "new_path")
    now = live.select("source_id", "path", F.col("digest").alias("now"))
    placed = entries.join(now, ["source_id", "path"], "left").join(moves, ["source_id", "path"], "left")
    presence = F.when(F.col("now") == F.col("digest"), "present").when(F.col("now").isNotNull(), "changed").when(F.col("new_path").isNotNull(), "moved").otherwise("missing")
    known = placed.select("record_id", "source_id", F.coalesce("new_path", "path").alias("path"), F.coalesce("now", "digest").alias("digest"), presence.alias("presence"))
    unknown = live.join(known.where("presence <> 'missing'").select("source_id", "path"), ["source_id", "path"], "left_anti")
    own = F.concat(F.lit("imp_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "path"), 256), 1, 24))
    every = known.unionByName(unknown.select(own.alias("record_id"), "source_id", "path", "digest", F.lit("imported").alias("presence")))
    pointed = sync.corrections(every, claims).select("record_id", "state", "superseded_by", "current")
    return every.join(pointed, "record_id")


def request_hash() -> Column:
    """Tells an exact retry of a request: its content, title and target, apart from the event's own identity."""
    return F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in ("content", "title", "target_id", "expected_revision", "target_source")))), 256)


def proposals(records: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with request_hash, the masked content and title, `outcome`, and of existing drafts record_id and revision.

    A request has request_id, event_key, source_id, title, content, target_id, target_source, expected_revision and
    expected_proposal_revision. An event has one draft: a request for it again is a duplicate if it asks the same, else
    it needs the draft's revision. A target must be one current record, accepted or imported, at the expected revision.
    Of several requests of one event the first by request_id counts; the others are duplicates or have a changed revision. Without an event or text a request is invalid.
    """
    asked = requests.withColumns({"event_key": F.coalesce("event_key", F.lit("")), "content": masked(F.trim("content")), "title": masked(F.col("title"))}).withColumn("request_hash", request_hash())
    first = asked.groupBy("event_key").agg(F.min(F.struct("request_id", "request_hash")).alias("first"))
    of_event = records.where("event_key is not null").groupBy("event_key").agg(F.count(F.lit(1)).alias("drafts"), F.min(F.struct(
        "record_id", F.col("source_id").alias("own_source"), "revision", "state", "current", F.col("request_hash").alias("own_hash"))).alias("own"))
    found = records.groupBy(F.col("record_id").alias("target_id"), F.col("source_id").alias("found_source")).agg(F.count(F.lit(1)).alias("same"), F.max(F.struct(
        "current", F.col("revision").alias("revision"), "state", digest("content").alias("digest"))).alias("found"))
    # a target without a source must be the only one of its id in any
    anywhere = found.groupBy("target_id").agg(F.sum("same").alias("n"), F.max(F.struct("found", "found_source")).alias("any"))
    within = found.select(F.col("target_id").alias("_key"), F.col("found_source").alias("target_source"), F.col("same").alias("n_in"), F.struct("found", "found_source").alias("in_source"))
    # requests without a target are spread over all tasks by a key that no record has
    keyed = asked.withColumn("_key", _spread("target_id", "request_id"))
    met = keyed.join(first, "event_key").join(of_event, "event_key", "left").join(anywhere.withColumnRenamed("target_id", "_key"), "_key", "left").join(within, ["_key", "target_source"], "left")
    named = F.col("target_source").isNotNull()
    n, target = F.coalesce(F.when(named, F.col("n_in")).otherwise(F.col("n")), F.lit(0)), F.when(named, F.col("in_source")).otherwise(F.col("any"))
    t, has = F.col("t.found"), F.col("target_id").isNotNull()
    valid = lambda c, most: (F.trim(F.coalesce(c, F.lit(""))) != "") & (F.length(c) <= most)
    own, exists = F.col("own"), F.col("drafts").isNotNull()
    outcome = (
        F.when(~valid(F.col("content"), MOST_CONTENT) | ~valid(F.col("title"), MOST_TITLE) | ~valid(F.col("event_key"), 512), "invalid_proposal")
        .when(F.col("drafts") > 1, "ambiguous_event_identity").when(exists & (own["own_source"] != F.col("source_id")), "event_of_another_source")
        .when(exists & F.coalesce(own["own_hash"] == F.col("request_hash"), F.lit(False)), "duplicate").when((F.col("first.request_id") != F.col("request_id")) & (F.col("first.request_hash") == F.col("request_hash")), "duplicate")
        .when(exists & ((own["state"] != "draft") | ~own["current"]), "proposal_already_reviewed")
        .when(exists & ~F.coalesce(F.col("expected_proposal_revision") == own["revision"], F.lit(False)) | (F.col("first.request_id") != F.col("request_id")), "proposal_revision_changed")
        .when(~has & (F.col("expected_revision").isNotNull() | named), "target_id_required").when(has & (F.col("n") == 0), "target_not_found").when(has & (F.col("n") > 1), "target_ambiguous")
        .when(has & exists & (own["record_id"] == F.col("target_id")), "self_correction").when(has & (~t["current"] | ~t["state"].isin("accepted", "imported")), "target_not_current")
        .when(has & ~F.coalesce(t["revision"] == F.col("expected_revision"), F.lit(False)), "target_revision_changed").when(exists, "revised").otherwise("created")
    )
    return met.withColumns({"n": n, "t": target}).withColumn("outcome", outcome).select(
        *asked.columns, "outcome", own["record_id"].alias("record_id"), own["revision"].alias("revision"),
        F.when(has, F.coalesce("target_source", "t.found_source")).alias("found_source"), F.when(has, t["digest"]).alias("target_digest"))


def proposed(answered: DataFrame) -> DataFrame:
    """The record rows, of RECORDS' columns, that the created and revised requests of proposals() make."""
    done = answered.where(F.col("outcome").isin("created", "revised"))
    new_id = F.concat(F.lit("rec_"), F.substring(F.sha2("event_key", 256), 1, 24))
    none = F.lit(None).cast("string")
    return done.select(
        F.coalesce("record_id", new_id).alias("record_id"), "source_id", (F.coalesce("revision", F.lit(0)) + 1).cast("int").alias("revision"), F.lit("draft").alias("state"), F.lit(True).alias("current"), "title", "content",
        "event_key", "request_hash", "target_id", F.col("found_source").alias("target_source"), F.col("expected_revision").cast("int").alias("target_revision"), "target_digest", none.alias("review_token"), none.alias("reviewed_by"),
        none.alias("superseded_by"))


def _spread(key: str, row: str) -> Column:
    """A join key that is `key`, and where that is null one of the row's own that nothing has: nulls of an outer join would all meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.col(row).cast("string")))


def _targets(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("record_id").alias("_key"), F.col("source_id").alias("target_source"), F.col("revision").alias("now_revision"), F.col("state").alias("now_state"), F.col("current").alias("now_current"),
        digest("content").alias("now_digest"), F.col("content").alias("old_content"))


def _conflict() -> Column:
    """What stands against accepting a draft, of a row of records joined with _targets(); null if nothing does."""
    return F.when(F.col("target_id").isNull(), None).when(F.col("now_digest").isNull(), "target_not_found").when(~F.col("now_current") | ~F.col("now_state").isin("accepted", "imported"), "target_not_current").when(
        F.col("now_revision") != F.col("target_revision"), "target_revision_changed").when(F.col("now_digest") != F.col("target_digest"), "target_content_changed")


def token() -> Column:
    """What a reviewer has seen: the digest of a draft's id, revision, title, content and target."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "revision", "title", "content", "target_id", "target_digest")))), 256)


def reviews(records: DataFrame) -> DataFrame:
    """(record_id, revision, title, token, conflict, diff) of every current draft: the diff is against its target, or against nothing."""
    drafts = records.where("state = 'draft' and current")
    met = drafts.withColumn("_key", _spread("target_id", "record_id")).join(_targets(records), ["_key", "target_source"], "left").select("record_id", "revision", "title", "content", token().alias("token"), _conflict().alias("conflict"), "old_content")
    texts = ledger.diffs(met, "record_id", "old_content", "content")
    return met.drop("content", "old_content").join(texts, "record_id")


def finished(records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((record_id, outcome) of each decision, the changed record rows).

    A decision has record_id, expected_revision, token, state (accepted or rejected) and reviewer. It takes effect on a
    current draft at that revision with that token, and to accept one also needs its target as it was; the same decision
    again is a duplicate. Several decisions on one record conflict unless they are equal. Accepting a correction takes a
    revision above its target's, and the target is superseded by it.
    """
    asked = decisions.groupBy("record_id").agg(F.count_distinct(F.struct("expected_revision", "token", "state")).alias("kinds"), F.min(F.struct("expected_revision", "token", "state", "reviewer")).alias("d"))
    met = asked.join(records, "record_id", "left").withColumn("_key", _spread("target_id", "record_id")).join(_targets(records), ["_key", "target_source"], "left")
    accept = F.col("d.state") == "accepted"
    outcome = (
        F.when(F.col("kinds") > 1, "contradictory").when(F.col("revision").isNull(), "not_found").when(~F.col("d.state").isin("accepted", "rejected"), "invalid_state")
        .when((F.col("review_token") == F.col("d.token")) & (F.col("state") == F.col("d.state")), "duplicate").when((F.col("state") != "draft") | ~F.col("current"), "proposal_already_reviewed")
        .when((F.col("revision") != F.col("d.expected_revision")) | ~F.coalesce(token() == F.col("d.token"), F.lit(False)), "proposal_changed_since_review")
        .when(accept & _conflict().isNotNull(), _conflict()).otherwise("done")
    )
    told = met.withColumn("outcome", outcome)
    done = told.where("outcome = 'done'")
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    above = F.when(accept & F.col("target_id").isNotNull(), F.greatest(F.col("revision"), F.col("target_revision") + 1)).otherwise(F.col("revision"))
    new = {"revision": above, "state": F.col("d.state"), "review_token": F.col("d.token"), "reviewed_by": F.col("d.reviewer")}
    decided = done.select(*(new.get(c, F.col(c)).alias(c) for c in columns))
    over = done.where(accept & F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("record_id"), F.col("target_source").alias("source_id")).agg(F.min("record_id").alias("by"))
    old = {"state": F.lit("superseded"), "current": F.lit(False), "superseded_by": F.col("by")}
    replaced = records.join(over, ["record_id", "source_id"]).select(*(old.get(c, F.col(c)).alias(c) for c in columns))
    return told.select("record_id", "outcome"), decided.unionByName(replaced)


def propose(spark: SparkSession, folder: str, requests: DataFrame) -> int:
    """Take requests into the versioned table of records; of concurrent writers one starts again on what the other left, so no proposal is lost."""
    return versions.update(spark, folder, "record_id", RECORDS, lambda records: proposed(proposals(records, requests)))


def finish(spark: SparkSession, folder: str, decisions: DataFrame, rebuild: Callable[[DataFrame, int], None] | None = None) -> int:
    """Decide on drafts of the versioned table; then rebuild(the records, the version), for an index that rests on them."""
    version = versions.update(spark, folder, "record_id", RECORDS, lambda records: finished(records, decisions)[1])
    if rebuild is not None:
        rebuild(versions.snapshot(spark, folder, "record_id", RECORDS, version), version)
    return version
