"""Queries on documents and records: synchronisation, identity, conversations, links, lists and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.operators import links, ranking, review, sync, threads, vault
from passagework.sources.tables import table
from passagework.streaming.events import event_key, first_deliveries


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return sync.snapshot(table(spark, d, "documents"), "source", "doc_id", "text")


def _older(spark: SparkSession, d: str) -> DataFrame:
    """An earlier state of the documents: every seventh missing, every fifth with another text."""
    docs = table(spark, d, "documents").where("doc_id % 7 <> 3")
    text = F.when(F.col("doc_id") % 5 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit(" older"))).otherwise(F.col("text"))
    return sync.snapshot(docs.withColumn("text", text), "source", "doc_id", "text")


_SNAP = "snap as (select source as source_id, doc_id::varchar as path, sha256(coalesce(text, '')) as digest from documents)"
_OLD = """old as (select source as source_id, doc_id::varchar as path, sha256(case when doc_id % 5 = 2 then coalesce(text, '') || ' older' else coalesce(text, '') end) as digest
from documents where doc_id % 7 <> 3)"""
_DIFF = f"""{_SNAP}, {_OLD}, diff as (select coalesce(s.source_id, o.source_id) as source_id, coalesce(s.path, o.path) as path,
case when o.digest is null then 'added' when s.digest is null then 'removed' when s.digest <> o.digest then 'changed' else 'unchanged' end as status
from snap s full join old o on s.source_id = o.source_id and s.path = o.path)"""


def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d)


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.difference(_older(spark, d), _snapshot(spark, d))


def index_health(spark: SparkSession, d: str) -> DataFrame:
    return sync.health(manifest_diff(spark, d))


def index_state_case(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds of each live document: excluded by its path, pending, or indexed."""
    return vault.index_states(_snapshot(spark, d), _older(spark, d), ["9*", "1?5"]).select("source_id", "path", "index_state")


def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Passages take the vector of an equal text from the cache of even documents, else from the pack of every third."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = docs.select("doc_id", F.sha2("text", 256).alias("key"))
    store = lambda rows, name: rows.groupBy("key").agg(F.lit(name).alias("vector"))
    found = sync.reused(docs, store(key.where("doc_id % 2 = 0"), "cached"), store(key.where("doc_id % 3 = 0"), "packed"), "text")
    return found.select("doc_id", "origin", "vector")


def rename_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of even number moved to new paths: unique texts are moves, copies are ambiguous."""
    now = _snapshot(spark, d).withColumn("source_id", F.lit("all"))
    moved = now.withColumn("path", F.when(F.col("path").cast("long") % 2 == 0, F.concat(F.lit("archive/"), "path")).otherwise(F.col("path")))
    return sync.renames(now, moved).select("digest", "old_path", "new_path", "verdict")


def correction_targets(spark: SparkSession, d: str) -> DataFrame:
    """Orders are records; line items with the largest discount claim to correct them, by id or by path and digest."""
    o = table(spark, d, "orders")
    records = o.select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus")).alias("digest"))
    li = table(spark, d, "lineitem").where("l_discount >= 0.09")
    by_id = F.col("l_linenumber") <= 2
    claims = li.join(records, li.l_orderkey == records.record_id).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.col("l_partkey").cast("string")).alias("claim_id"),
        F.when(by_id, F.col("l_orderkey")).alias("target_id"), F.when(~by_id, F.col("path")).alias("target_path"), F.when(~by_id, F.col("digest")).alias("target_digest"),
    )
    return sync.corrections(records, claims).select("record_id", "state", "superseded_by", "current")


def eligibility_semi(spark: SparkSession, d: str) -> DataFrame:
    """Indexed documents that are unchanged and whose label doesn't reject them."""
    states = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("path")).agg(
        F.when(F.max("toxic") == 1, "rejected").when(F.min("quality") == 0, "draft").otherwise("accepted").alias("state"))
    return sync.eligible(_older(spark, d), _snapshot(spark, d), states).select("source_id", "path", F.coalesce("state", F.lit("imported")).alias("state"))


def sessionise_turns(spark: SparkSession, d: str) -> DataFrame:
    return threads.exchanges(table(spark, d, "conversations")).select("conv_id", "i", F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5"))


_EXCHANGES = """n as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn, role rows unbounded preceding)::bigint as i from conversations),
x as (select conv_id, i, arg_max(text, turn) filter (role = 'user') as user_text, coalesce(arg_max(text, turn) filter (role = 'assistant'), '') as assistant from n where i > 0 group by all)"""


def pack_windows(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation in consecutive parts of at most 4,000 characters, 24 for each turn's mark."""
    rows = table(spark, d, "conversations")
    return threads.packed(rows, "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))) + 24, 4000)


def hold_back_newest(spark: SparkSession, d: str) -> DataFrame:
    return threads.held_back(threads.exchanges(table(spark, d, "conversations")).select("conv_id", "i"), "conv_id", "i")


def context_two_before(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("text"))
    return threads.with_two_before(rows, "conv_id", "turn", "text").select("conv_id", "turn", "before_2", "before_1")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """One item an exchange: its quote is a stretch of the assistant's text with other white space, wrongly cited every third time."""
    x = threads.exchanges(table(spark, d, "conversations")).where(F.length("assistant") >= 60)
    return x.select(
        (F.col("conv_id") * 1000 + F.col("i")).alias("item_id"), "conv_id", F.when(F.col("i") % 3 == 0, F.col("i") + 1).otherwise(F.col("i")).alias("exchange"),
        F.replace(F.substring("assistant", 11, 40), F.lit(" "), F.lit("  ")).alias("quote"), F.col("user").alias("statement"),
    )


def quote_contains_join(spark: SparkSession, d: str) -> DataFrame:
    return threads.verified_quotes(_items(spark, d), threads.exchanges(table(spark, d, "conversations")))


def later_context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Later exchanges whose reply shares stems with the statement only, as the SQL has it; later_context_texts has all."""
    return threads.later_sharing(_items(spark, d), threads.exchanges(table(spark, d, "conversations")), 3000)


def later_context_texts(spark: SparkSession, d: str) -> DataFrame:
    """All later exchanges of each item within 12,000 characters, with texts; the statement's first two words are the keywords."""
    items = _items(spark, d).withColumn("keywords", F.slice(F.split("statement", " "), 1, 2))
    return threads.later_context(items, threads.exchanges(table(spark, d, "conversations")))


_ITEMS = _EXCHANGES + """, items as (select conv_id * 1000 + i as item_id, conv_id, case when i % 3 = 0 then i + 1 else i end as exchange, replace(substr(assistant, 11, 40), ' ', '  ') as quote, user_text as statement
from x where length(assistant) >= 60)"""
_STEMS = r"list_distinct(list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{4,}}'), lambda t: t[1:5]))"
_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def html_link_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.html_links(table(spark, d, "pages"), "page_id", "html").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, href) of every link of the pages."""
    return links.html_links(table(spark, d, "pages"), "page_id", "html")


def link_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Pages as notes in a folder of their site and language, with links by path, to a sibling, by the end of a path, by name and upwards."""
    k = F.expr("page_id div 2").cast("string")
    folder = F.concat_ws("/", F.regexp_extract("url", r"//([^/]+)/", 1), F.regexp_extract("url", r"//[^/]+/([a-z]+)/", 1))
    p = table(spark, d, "pages").select("page_id", folder.alias("folder"), F.col("page_id").cast("string").alias("id"), k.alias("k"))
    text = F.concat(*(F.lit(x) if x != "k" else F.col("k") for x in ("see [[all/page-", "k", ".md]], [[part#intro|its part]], [[", "k", "/part]], [[", "k", "]], [up](../", "k", ".md) and [[nowhere/", "k", "]]")))
    written = p.select("page_id", F.concat("folder", F.lit("/"), "id", F.lit("/index.md")).alias("path"), text.alias("text"))
    paths = F.array(F.concat(F.lit("all/page-"), "id", F.lit(".md")), *(F.concat("folder", F.lit("/"), "id", F.lit(end)) for end in (".md", "/index.md", "/part.md")))
    found = links.resolved(links.note_links(written, "path", "text"), p.select(F.explode(paths).alias("path")), "path")
    return found.join(written.select("page_id", "path"), "path").select("page_id", "href", "target")


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    found = links.backlinks(_paths(spark, d), "page_id", "href")
    return found.select("href", "n_pages", F.col("pages")[0].alias("first_page"), F.size("pages").alias("listed"))


def undirected_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the hosts' sites: a page joins its own site and each language section it is in."""
    return links.edges(_sites(spark, d), "a", "b")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select(F.regexp_extract("url", r"//([^/]+)/", 1).alias("a"), F.regexp_extract("url", r"//[^/]+/([a-z]+)/", 1).alias("b"))


def degree(spark: SparkSession, d: str) -> DataFrame:
    return links.degrees(links.edges(_sites(spark, d), "a", "b"))





def retain_latest_two(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return ranking.top(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


def latest_per_path(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type", "e.value")


def range_listing(spark: SparkSession, d: str) -> DataFrame:
    """One order a customer in the last quarter of 1997: the newest, of equal days the dearest."""
    o = table(spark, d, "orders").where("o_orderdate between timestamp_ntz'1997-10-01' and timestamp_ntz'1997-12-31'")
    return ranking.top(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))




def session_gap(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with gaps under 30 minutes."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return s.select("user_id", "n", "first_event")


def exactly_once_events(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered twice, some of them altered: accepted once, replays counted, altered ones refused."""
    e = table(spark, d, "events").select("event_id", event_key(F.lit("client"), F.col("user_id"), F.col("event_id")).alias("key"), F.col("props").alias("body"), F.lit(0).alias("seq"))
    again = e.where("event_id % 4 = 0").withColumn("body", F.when(F.col("event_id") % 8 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))).withColumn("seq", F.lit(1))
    found = first_deliveries(e.unionByName(again), "key", "body", "seq").join(e.select("key", "event_id"), "key")
    return found.select("event_id", F.md5("body").alias("body_md5"), "replays", "refused")


def echo_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Clicks ("me") that repeat the number of a view ("others") of their user within ten seconds of it or less."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    speaker = F.when(F.col("event_type") == "click", "me").otherwise("others")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("double")
    said = F.concat_ws(" ", F.lit("number"), F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string")))
    lines = e.select((F.col("user_id") % 10).alias("meeting"), F.col("event_id").alias("n"), start.alias("start"), speaker.alias("speaker"), said.alias("text"))
    return threads.without_echo(lines).groupBy("meeting", "speaker").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("sum_ids"))


def conformance_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts over all documents: without text, with headings, links, e-mail addresses, license lines."""
    t = F.coalesce("text", F.lit(""))
    has = lambda p: F.count_if(t.rlike(p))
    return table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.trim(t) == "").alias("empty"), has(r"(^|\n)#{1,6} ").alias("with_heading"), has(r"https?://").alias("with_url"),
        has(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}").alias("with_mail"), has(r"[Ll]icen[sc]ed? ").alias("with_license"), F.count_if(F.length(t) != F.col("n_chars")).alias("wrong_length"),
    )


def overview_by_folder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("latest"))


def recent_topn(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(12).select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").cast("string").alias("day"))


def mode_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The most used spelling of each part colour's first letters, ties to the least."""
    p = table(spark, d, "part").select(F.lower(F.substring("p_name", 1, 2)).alias("fold"), F.concat_ws(" ", F.split("p_name", " ")[0], "p_brand").alias("name"))
    n = p.groupBy("fold", "name").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top(n, ["fold"], [F.desc("n"), F.asc("name")], 1).select("fold", "name", "n")


def classify_case(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as items with a judge's scores; those without a label are new. Verdict and attribution, counted by language."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    score = lambda c: F.when(F.col("quality").isNotNull(), c)
    rows = both.select(
        "lang", F.when(F.col("doc_id") % 2 == 0, "decision").otherwise("fact").alias("type"), score(F.when(F.col("quality") == 0, 0.2).otherwise(0.9)).alias("supported"), score(F.lit(0.5)).alias("durable"),
        score(F.when(F.col("toxic") == 1, 0.7).otherwise(0.1)).alias("withdrawn"), score(F.when(F.col("n_chars") < 500, 0.4).otherwise(0.6)).alias("owner_stated"),
    )
    return review.classified(rows).groupBy("lang", "verdict", "attribution").agg(F.count(F.lit(1)).alias("n"))


def trust_lifecycle_view(spark: SparkSession, d: str) -> DataFrame:
    """Lifecycle, trust and staleness of each event's record, from its JSON number and its kind."""
    from passagework.functions.records import lifecycle, trust

    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 5 == 0, "Draft").when(k % 5 == 1, "stable").when(k % 5 == 2, " deprecated ").when(k % 5 == 3, "wip")
    by = F.when(F.col("event_type") == "purchase", F.array(F.lit("human:ann"))).when(F.col("event_type") == "click", F.array(F.lit("bot:ci"))).otherwise(F.array().cast("array<string>"))
    life = lifecycle(status, F.lit(None).cast("string"))
    stale = F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")
    return e.groupBy(life["status"].alias("status"), life["known"].alias("known"), trust(by).alias("trust"), stale.alias("stale")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    snapshot_digest, manifest_diff, index_health, index_state_case, vector_reuse, rename_reconcile, correction_targets, eligibility_semi, sessionise_turns, pack_windows,
    hold_back_newest, context_two_before, quote_contains_join, later_context_budget, later_context_texts, html_link_targets, link_resolve, backlinks, undirected_edge_weights, degree,
    retain_latest_two, latest_per_path, range_listing, session_gap,
    exactly_once_events, echo_interval_join, conformance_counts, overview_by_folder, recent_topn, mode_spelling, classify_case, trust_lifecycle_view,
)}
_HREF = """links as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages)"""
_SITES = "sites as (select regexp_extract(url, '//([^/]+)/', 1) as a, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) as b from pages), edges as (select least(a, b) as a, greatest(a, b) as b, count(*) as weight from sites where a <> b group by 1, 2)"
SQL = {
    "snapshot_digest": f"with {_SNAP} select * from snap",
    "manifest_diff": f"with {_DIFF} select * from diff",
    "index_health": f"""with {_DIFF} select count(*) filter (status = 'added') as added, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'removed') as removed,
count(*) filter (status = 'unchanged') as unchanged, case when count(*) filter (status <> 'unchanged') = 0 then 'fresh' else 'stale' end as state from diff""",
    "index_state_case": f"""with {_SNAP}, {_OLD} select s.source_id, s.path, case when s.path like '9%' or s.path like '1_5' then 'excluded' when coalesce(o.digest = s.digest, false) then 'indexed' else 'pending' end as index_state
from snap s left join old o on s.source_id = o.source_id and s.path = o.path""",
    "vector_reuse": """with k as (select doc_id, sha256(coalesce(text, '')) as key from documents)
select doc_id, case when key in (select key from k where doc_id % 2 = 0) then 'cache' when key in (select key from k where doc_id % 3 = 0) then 'pack' else 'embed' end as origin,
case when key in (select key from k where doc_id % 2 = 0) then 'cached' when key in (select key from k where doc_id % 3 = 0) then 'packed' end as vector from k""",
    "rename_reconcile": """with k as (select doc_id::varchar as path, sha256(coalesce(text, '')) as digest from documents where doc_id % 2 = 0)
select digest, min(path) as old_path, 'archive/' || min(path) as new_path, case when count(*) = 1 then 'moved' else 'ambiguous' end as verdict from k group by 1""",
    "correction_targets": """with c as (select l_orderkey, l_orderkey || '-' || lpad(l_linenumber::varchar, 3, '0') || '-' || l_partkey as claim from lineitem join orders on l_orderkey = o_orderkey where l_discount >= 0.09),
n as (select l_orderkey, count(*) as n, min(claim) as claim from c group by 1)
select o_orderkey as record_id, case when n = 1 then 'corrected' when n > 1 then 'conflict' else 'accepted' end as state, case when n = 1 then claim end as superseded_by, coalesce(n, 0) <> 1 as current
from orders left join n on o_orderkey = l_orderkey""",
    "eligibility_semi": f"""with {_SNAP}, {_OLD}, st as (select source as source_id, doc_id::varchar as path, case when max(toxic) = 1 then 'rejected' when min(quality) = 0 then 'draft' else 'accepted' end as state
from documents join labels using (doc_id) group by 1, 2)
select o.source_id, o.path, coalesce(state, 'imported') as state from old o join snap s on s.source_id = o.source_id and s.path = o.path and s.digest = o.digest
left join st on st.source_id = o.source_id and st.path = o.path where coalesce(state, 'imported') not in ('rejected', 'draft')""",
    "sessionise_turns": f"with {_EXCHANGES} select conv_id, i, md5(user_text) as user_md5, md5(assistant) as assistant_md5 from x",
    "pack_windows": """with recursive s as (select conv_id, turn, length(coalesce(text, '')) + 24 as n, row_number() over (partition by conv_id order by turn) as r from conversations),
p(conv_id, turn, r, used, part) as (select conv_id, turn, r, n, 0 from s where r = 1
 union all select s.conv_id, s.turn, s.r, case when used + n <= 4000 then used + n else n end, case when used + n <= 4000 then part else part + 1 end from p join s on s.conv_id = p.conv_id and s.r = p.r + 1)
select conv_id, turn, part from p""",
    "hold_back_newest": f"with {_EXCHANGES} select conv_id, i from x where i < (select max(y.i) from x y where y.conv_id = x.conv_id)",
    "context_two_before": "select conv_id, turn, lag(md5(text), 2) over w as before_2, lag(md5(text), 1) over w as before_1 from conversations window w as (partition by conv_id order by turn)",
    "quote_contains_join": rf"""with {_ITEMS}, said as (select conv_id, i, 0 as who, lower(trim(regexp_replace(user_text, '\s+', ' ', 'g'))) as t from x union all select conv_id, i, 1, lower(trim(regexp_replace(assistant, '\s+', ' ', 'g'))) from x),
h as (select item_id, s.i, who, row_number() over (partition by item_id order by s.i <> exchange, s.i, who) as r from items join said s using (conv_id)
where trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' and contains(t, lower(trim(regexp_replace(quote, '\s+', ' ', 'g')))))
select item_id, i, case when who = 0 then 'owner' else 'assistant' end as speaker from h where r = 1""",
    "later_context_budget": f"""with {_ITEMS}, l as (select item_id, x.i, least(length(user_text), 400) + least(length(assistant), 1500) as size from items join x on x.conv_id = items.conv_id and x.i > exchange
where len(list_intersect({_STEMS.format('statement')}, {_STEMS.format('assistant')})) >= 2),
r as (select *, sum(size) over (partition by item_id order by i desc rows unbounded preceding)::bigint as running from l) select * from r where running <= 3000""",
    "later_context_texts": rf"""with {_ITEMS}, asked as (select *, {_STEMS.format("(statement || ' ' || quote)")} as terms, {_STEMS.format("array_to_string(string_split(statement, ' ')[1:2], ' ')")} as keys from items),
p as (select conv_id, i, unnest(string_split(regexp_replace(regexp_replace(assistant, '([.!?]){_BLANK}+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g'), chr(2))) as s, generate_subscripts(string_split(regexp_replace(regexp_replace(assistant, '([.!?]){_BLANK}+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g'), chr(2)), 1) as k from x),
q as (select *, {_STEMS.format('s')} as st, row_number() over (partition by conv_id, i order by k) as n from p where trim(regexp_replace(s, '{_BLANK}+', ' ', 'g')) <> ''),
h as (select item_id, q.i, n, s, list_has_any(st, keys) or len(list_intersect(st, terms)) >= 2 as hit from asked join q on q.conv_id = asked.conv_id and q.i > exchange),
k as (select *, hit or coalesce(lag(hit) over (partition by item_id, i order by n), false) as keep from h),
t as (select item_id, i, substr(string_agg(s, ' ' order by n), 1, 1500) as about from k where keep group by all),
l as (select item_id, x.i, substr(coalesce(user_text, ''), 1, 400) as owner, coalesce(about, '') as assistant from items join x on x.conv_id = items.conv_id and x.i > exchange left join t using (item_id, i)),
r as (select *, length(owner) + length(assistant) as size, sum(length(owner) + length(assistant)) over (partition by item_id order by i desc rows unbounded preceding)::bigint as running from l) select * from r where running <= 12000""",
    "html_link_targets": f"with {_HREF} select page_id, href, count(*) as n from links group by all",
    "link_resolve": r"""with p as (select page_id, regexp_extract(url, '//([^/]+)/', 1) || '/' || regexp_extract(url, '//[^/]+/([a-z]+)/', 1) as folder, page_id // 2 as k from pages),
o as (select p.page_id, p.folder, p.k, t.folder as there from p join p t on t.page_id = p.k)
select page_id, 'all/page-' || k || '.md' as href, 'all/page-' || k || '.md' as target from o union all
select page_id, 'part', folder || '/' || page_id || '/part.md' from p union all
select page_id, k || '/part', there || '/' || k || '/part.md' from o union all
select page_id, k::varchar, there || '/' || k || '.md' from o union all
select page_id, folder || '/' || k || '.md', folder || '/' || k || '.md' from o where folder = there""",
    "backlinks": f"with {_HREF} select href, count(distinct page_id) as n_pages, min(page_id) as first_page, least(count(distinct page_id), 200)::int as listed from links group by 1",
    "undirected_edge_weights": f"with {_SITES} select * from edges",
    "degree": f"with {_SITES} select node, count(*) as degree from (select a as node from edges union all select b from edges) group by 1",
    "retain_latest_two": "select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders) where rank <= 2",
    "latest_per_path": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1",
    "range_listing": """select o_custkey, o_orderkey, o_orderdate::date::varchar as day from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_totalprice desc, o_orderkey) as r
from orders where o_orderdate between timestamp '1997-10-01' and timestamp '1997-12-31') where r = 1""",
    "session_gap": """with g as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, count(*) as n, min(event_id) as first_event from s group by user_id, k""",
    "exactly_once_events": """select event_id, md5(props) as body_md5, case when event_id % 4 = 0 and event_id % 8 <> 0 then 1 else 0 end::bigint as replays, case when event_id % 8 = 0 then 1 else 0 end::bigint as refused from events""",
    "echo_interval_join": """with l as (select user_id % 10 as meeting, event_id as n, epoch_us(ts) / 60000000.0 as start, case when event_type = 'click' then 'me' else 'others' end as speaker,
(json_extract_string(props, '$.k'))::int % 4 as w from events where event_type in ('click', 'view'))
select meeting, speaker, count(*) as n_lines, sum(n)::bigint as sum_ids from l where speaker = 'others' or not exists (select 1 from l o where o.meeting = l.meeting and o.speaker = 'others' and o.w = l.w and l.start - o.start between -1 and 4)
group by all""",
    "conformance_counts": r"""select count(*) as documents, count(*) filter (trim(coalesce(text, '')) = '') as empty, count(*) filter (regexp_matches(coalesce(text, ''), '(^|\n)#{1,6} ')) as with_heading,
count(*) filter (regexp_matches(coalesce(text, ''), 'https?://')) as with_url, count(*) filter (regexp_matches(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}')) as with_mail,
count(*) filter (regexp_matches(coalesce(text, ''), '[Ll]icen[sc]ed? ')) as with_license, count(*) filter (length(coalesce(text, '')) <> n_chars) as wrong_length from documents""",
    "overview_by_folder": "select source, count(*) as n, sum(n_chars)::bigint as chars, count(*) filter (n_chars < 200) as short, count(distinct lang) as langs, max(doc_id) as latest from documents group by 1",
    "recent_topn": "select o_orderkey, o_orderpriority, o_orderdate::date::varchar as day from orders order by o_orderdate desc, o_orderkey desc limit 12",
    "mode_spelling": """with n as (select lower(substr(p_name, 1, 2)) as fold, string_split(p_name, ' ')[1] || ' ' || p_brand as name, count(*) as n from part group by all)
select fold, name, n from (select *, row_number() over (partition by fold order by n desc, name) as r from n) where r = 1""",
    "classify_case": """with i as (select lang, case when quality is null then 'new' when quality = 0 then 'drop' when toxic = 1 then 'review' else 'new' end as verdict, quality, doc_id, n_chars from documents left join labels using (doc_id))
select lang, verdict, case when verdict = 'new' and quality is not null and doc_id % 2 = 0 and n_chars < 500 then 'assistant' else 'owner' end as attribution, count(*) as n from i group by all""",
    "trust_lifecycle_view": """with e as (select *, json_extract_string(props, '$.k')::int % 5 as k from events)
select case k when 0 then 'draft' when 2 then 'deprecated' else 'stable' end as status, k <> 3 as known,
case event_type when 'purchase' then 'human-reviewed' when 'click' then 'machine-confirmed' else 'unverified' end as trust, ts < timestamp '2024-01-08' as stale, count(*) as n from e group by all""",
}
