"""Queries on harvesting, intake, and the lifecycle of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import intake, lifecycle
from passagework.sources import notes
from passagework.sources.tables import table
from passagework.streaming.harvest import TooLong, harvested


def _careful_reader():
    """A stand-in for an extractor: an item for each text over 100 characters; takes 700 characters at a time and no text over 380."""

    def extract(rows):
        if any(len(t) > 380 for _, t in rows):
            raise ValueError("not this text")
        if sum(len(t) for _, t in rows) > 700:
            raise TooLong
        return [f"{i}" for i, t in rows if len(t) > 100]

    return extract


def harvest_marks(spark: SparkSession, d: str) -> DataFrame:
    """What people said in each conversation, past its mark and but the newest, handed to an extractor that refuses some; the marks after it."""
    said = table(spark, d, "conversations").where("role = 'user' and text is not null")
    exchanges = said.select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").alias("i"), "text")
    marks = said.select(F.col("conv_id").cast("string").alias("thread"), (F.col("conv_id") % 3 - 1).cast("int").alias("done")).distinct()
    return harvested(exchanges, marks, _careful_reader, part=16).drop("errors")


def _clients(spark: SparkSession, d: str) -> DataFrame:
    """The regions as clients: one has not opted in, one is paused, one is too old; the last two are fine."""
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(
        F.col("r_name").alias("client"), (k != 1).alias("opt_in"), (k == 2).alias("paused"), F.when(k == 3, "unsupported_version").otherwise("supported").alias("capability"), F.lit("prompt_id").alias("id_field"))


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of the conversations as an event that a region's client sent; some twice, some with another text, some broken."""
    said, k = table(spark, d, "conversations"), F.col("conv_id") % 13
    client = F.element_at(F.array(*(F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "MARS", "AFRICA", "MIDDLE EAST"))), (F.col("conv_id") % 8 + 1).cast("int"))
    event = F.to_json(F.struct(
        F.when(F.col("role") == "user", "UserPromptSubmit").otherwise("Stop").alias("hook_event_name"), F.col("conv_id").cast("string").alias("session_id"),
        F.when(k != 5, (F.col("turn") / 4).cast("int").cast("string")).alias("prompt_id"), F.when(k == 7, F.lit("same words")).otherwise(F.col("text")).alias("prompt")))
    name = F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 5, "0"), F.col("role"))
    raw = said.where("text is not null").select(name.alias("name"), client.alias("client"), F.octet_length("text").cast("bigint").alias("size"), F.when(k == 6, F.substring(event, 2, 1 << 20)).otherwise(event).alias("body"))
    return intake.identified(intake.judged(raw, _clients(spark, d), 360))


def intake_states(spark: SparkSession, d: str) -> DataFrame:
    """How many events of each client came to which state."""
    return _receipts(spark, d).groupBy("client", "state").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("last"))


def capture_status(spark: SparkSession, d: str) -> DataFrame:
    """Every client's state by its settings and its last event."""
    return intake.status(_receipts(spark, d), _clients(spark, d)).drop("action")


def record_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of what was known: some have moved, changed or gone, some were never known, and toxic ones are corrected."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 10
    rows = docs.select(F.concat(F.lit("r"), F.col("doc_id")).alias("record_id"), F.lit("notes").alias("source_id"), F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), k.alias("k"))
    entries = rows.where("k <> 7").drop("k")
    path = F.when(F.col("k") == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    live = rows.where("k <> 4").select("source_id", path.alias("path"), F.when(F.col("k") == 5, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    none = F.lit(None).cast("string")
    claims = table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("c"), F.col("doc_id")).alias("claim_id"), F.concat(F.lit("r"), F.col("doc_id")).alias("target_id"), none.alias("target_path"), none.alias("target_digest"))
    return lifecycle.catalog(entries, live, claims).withColumn("record_id", F.when(F.col("presence") != "imported", F.col("record_id")))


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(documents as records, half of them drafts of events; the turns of conversations as requests for these events, answers to correct another document)."""
    key, conv, turn = F.col("doc_id"), F.col("conv_id"), F.col("turn")
    k = key % 4
    records = table(spark, d, "documents").select(
        key.cast("string").alias("record_id"), F.lit("s").alias("source_id"), (key % 3 + 1).cast("int").alias("revision"), F.when(k < 2, "draft").when(k == 2, "accepted").otherwise("imported").alias("state"),
        (key % 11 != 0).alias("current"), F.coalesce("text", F.lit("")).alias("content"), F.when(k < 2, F.concat(F.lit("e"), key)).alias("event_key"), F.lit(None).cast("string").alias("request_hash"))
    correcting, target = F.col("role") == "assistant", conv * 3 + turn
    requests = table(spark, d, "conversations").select(
        F.concat_ws("-", F.lpad(conv.cast("string"), 9, "0"), F.lpad(turn.cast("string"), 5, "0"), "role").alias("request_id"), F.concat(F.lit("e"), conv).alias("event_key"),
        F.when(conv % 17 == 0, "other").otherwise("s").alias("source_id"), F.col("role").alias("title"), F.concat(F.lit("part "), turn % 3).alias("content"), F.when(correcting, target.cast("string")).alias("target_id"),
        F.lit(None).cast("string").alias("target_source"), F.when(correcting, target % 3 + F.when(turn % 5 == 4, 2).otherwise(1)).cast("int").alias("expected_revision"), (turn % 3 + 1).cast("int").alias("expected_proposal_revision"))
    return records, requests


def proposal_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every request: a draft created or revised, a duplicate, or why not."""
    return lifecycle.proposals(*_requests(spark, d)).select("request_id", "event_key", "outcome", "revision")


def front_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Documents held as literal block scalars in front matter, between values with comments behind quotes; read back whole."""
    header = F.when(F.col("doc_id") % 2 == 0, "m: |2-").otherwise("m: |2 # whole")
    text = F.concat(F.lit("---\nowner: 'it''s ann' # said so\n"), header, F.lit("\n  "), F.replace("text", F.lit("\n"), F.lit("\n  ")), F.lit('\nafter: "x # y"  # end\n---\nbody'))
    front = notes.parsed(table(spark, d, "documents").where("text is not null").select("doc_id", text.alias("content")))
    get = lambda p: F.get_json_object("front", p)
    return front.select("doc_id", get("$.owner").alias("owner"), F.md5(get("$.m")).alias("m_md5"), get("$.after").alias("after"), "body")


QUERIES = {f.__name__: f for f in (harvest_marks, intake_states, capture_status, record_catalog, proposal_outcomes, front_scalars)}
_RECEIPTS = """raw as (select lpad(conv_id::varchar, 9, '0') || '-' || lpad(turn::varchar, 5, '0') || '-' || role as name, text, role, conv_id, turn // 4 as native, conv_id % 13 as k,
  ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'MARS', 'AFRICA', 'MIDDLE EAST'][conv_id % 8 + 1] as client from conversations where text is not null),
judged as (select *, case client when 'MARS' then 'not_configured' when 'ASIA' then 'paused' when 'AMERICA' then 'opt_in_required' when 'EUROPE' then 'unsupported_version' else
  case when octet_length(encode(text)) > 360 then 'payload_too_large' when k = 6 then 'invalid_payload' when role <> 'user' then 'unsupported_event' when k = 5 then 'missing_event_identity'
  when k <> 7 and trim(text) = '' then 'invalid_payload' else 'captured' end end as s, case when k = 7 then 'same words' else text end as prompt from raw),
firsts as (select client, conv_id, native, arg_min(prompt, name) as prompt, min(name) as name from judged where s = 'captured' group by all),
receipts as (select j.client, j.name, case when s <> 'captured' then s when j.name = f.name then s when j.prompt = f.prompt then 'duplicate' else 'event_identity_conflict' end as state
  from judged j left join firsts f using (client, conv_id, native))"""
SQL = {
    "front_scalars": r"""with t as (select doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(\n *)+$', '') as t from documents where text is not null)
select doc_id, 'it''s ann' as owner, md5(case when trim(t, ' ') = '' then '' when doc_id % 2 = 0 then t else t || chr(10) end) as m_md5, 'x # y' as after, 'body' as body from t""",
    "harvest_marks": """with u as (select * from conversations where role = 'user' and text is not null), l as (select conv_id, max(turn) as last from u group by 1),
g as (select conv_id, count(*) as n, max(turn) as upto, count(*) filter (length(text) > 100) as items, bool_or(length(text) > 380) as bad from u join l using (conv_id) where turn > conv_id % 3 - 1 and turn < last group by 1 having count(*) >= 2)
select conv_id::varchar as thread, case when n is null then 'empty' when bad then 'pending' else 'done' end as status, case when not bad then upto else conv_id % 3 - 1 end::bigint as done,
coalesce(n, 0) as n, case when not bad then items else 0 end as items from l left join g using (conv_id)""",
    "intake_states": f"with {_RECEIPTS} select client, state, count(*) as n, max(name) as last from receipts group by all",
    "capture_status": f"""with {_RECEIPTS}, last as (select client, arg_max(state, name) as latest, max(name) filter (state in ('captured', 'duplicate')) as last_success, count(*) as receipts from receipts group by 1)
select r_name as client, case r_regionkey when 2 then 'paused' when 3 then 'unsupported_version' else coalesce(latest, 'no_receipt') end as state, last_success, coalesce(receipts, 0) as receipts from region left join last on client = r_name""",
    "record_catalog": """with rows as (select 'r' || doc_id as record_id, doc_id::varchar as path, sha256(coalesce(text, '')) as digest, doc_id % 10 as k from documents),
live as (select case when k = 2 then 'moved/' || path else path end as path, case when k = 5 then sha256(digest) else digest end as digest from rows where k <> 4),
entries as (select * from rows where k <> 7),
gone as (select digest, count(*) as n, min(path) as path from entries where path not in (select path from live) group by 1), fresh as (select digest, count(*) as n, min(path) as new_path from live where path not in (select path from entries) group by 1),
moves as (select gone.path, new_path from gone join fresh using (digest) where gone.n = 1 and fresh.n = 1),
known as (select record_id, coalesce(new_path, e.path) as path, coalesce(l.digest, e.digest) as digest, case when l.digest = e.digest then 'present' when l.digest is not null then 'changed' when new_path is not null then 'moved' else 'missing' end as presence
  from entries e left join live l on l.path = e.path left join moves m on m.path = e.path),
every as (select * from known union all select null, path, digest, 'imported' from live where path not in (select path from known where presence <> 'missing')),
claims as (select 'r' || doc_id as record_id, count(*) as n, min('c' || doc_id) as claim from labels where toxic = 1 group by 1)
select record_id, 'notes' as source_id, path, digest, presence, case when n = 1 then 'corrected' when n > 1 then 'conflict' else 'accepted' end as state, case when n = 1 then claim end as superseded_by, coalesce(n, 0) <> 1 as current
from every left join claims using (record_id)""",
    "proposal_outcomes": """with rec as (select doc_id as id, doc_id % 3 + 1 as revision, case doc_id % 4 when 2 then 'accepted' when 3 then 'imported' else 'draft' end as state, doc_id % 11 <> 0 as current from documents),
asked as (select *, lpad(conv_id::varchar, 9, '0') || '-' || lpad(turn::varchar, 5, '0') || '-' || role as request_id, case when role = 'assistant' then conv_id * 3 + turn end as target from conversations),
req as (select request_id, conv_id as event, conv_id % 17 = 0 as other, target, target % 3 + case when turn % 5 = 4 then 2 else 1 end as expected, turn % 3 + 1 as own,
  turn % 3 || '|' || role || '|' || coalesce(target || '|' || (turn % 5 = 4), '') as asks from asked),
met as (select r.*, first_value(request_id) over w as f, first_value(asks) over w as fa, e.revision as drev, e.state is not null as has_draft, e.current as dcurrent, e.id as did, t.revision as trev, t.state as tstate, t.current as tcurrent, t.id as tid
  from req r left join rec e on e.id = event and e.state = 'draft' left join rec t on t.id = target window w as (partition by event order by request_id))
select request_id, 'e' || event as event_key, case when has_draft and other then 'event_of_another_source' when f <> request_id and fa = asks then 'duplicate' when has_draft and not dcurrent then 'proposal_already_reviewed'
  when (has_draft and own <> drev) or f <> request_id then 'proposal_revision_changed' when target is not null and tid is null then 'target_not_found' when has_draft and target = did then 'self_correction'
  when target is not null and (not tcurrent or tstate = 'draft') then 'target_not_current' when target is not null and trev <> expected then 'target_revision_changed' when has_draft then 'revised' else 'created' end as outcome, drev::integer as revision from met""",
}
