"""Queries on notes: views of front matter, listings, approvals, commit dates, topic names, and how well a search answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import front as fm
from passagework.functions.text import guessed_name, imported_id, moment, plain_key
from passagework.operators import commits, evaluation, labels, vault
from passagework.queries.search import _TOP, SQL_BM25, _bm25
from passagework.sources.tables import table

NOW = "2025-06-01 00:00:00"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes whose front matter has every shape that the views read, by the number of the document."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    case = lambda m, *values: F.coalesce(*(F.when(i % m == k, F.lit(v)) for k, v in enumerate(values) if v is not None))
    parts = [
        F.concat(F.lit('"type":"'), case(7, "chat-raw", "source", "note", "note", "note", "note", "note"), F.lit('"')),
        case(5, '"status":"draft"', '"status":"stable"', '"status":" Deprecated "', '"status":"wip"', None), F.when(i % 10 == 4, F.lit('"draft":"yes"')),
        case(3, '"verified":{"by":"human:ann","at":"2025-01-01"}', '"verified":[{"by":"bot"},{"at":"x"}]', None), case(4, '"sources":"src"', '"sources":[{"resource":" a/b.md ","title":"T"},"https://x.y/z"]', '"sources":[["Note"]]', None),
        F.when(i % 17 == 0, F.lit('"lock":true')), F.when(i % 6 == 0, F.lit('"session":{"extractor":"x"}')), F.when(i % 9 == 0, F.lit('"stale_after":"2025-01-01"')),
        F.when(i % 2 == 0, F.concat(F.lit('"description":"about '), n, F.lit('"'))).otherwise(F.concat(F.lit('"summary":"old '), n, F.lit('"'))),
    ]
    path = F.when(i % 8 == 0, F.concat(F.lit("+/"), n, F.lit(".md"))).when(i % 8 == 1, F.concat(n, F.lit("_index.md"))).when(i % 8 == 2, F.concat(F.lit("x/"), n, F.lit(".md"))).otherwise(F.concat(F.lit("notes/"), n, F.lit(".md")))
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("source_id"), path.alias("path"), F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("front"),
        F.when(i % 3 == 0, F.concat(F.lit("Heading "), n)).alias("heading"), F.timestamp_add("HOUR", -(i % 400).cast("int"), F.lit(NOW).cast("timestamp")).alias("modified"),
    )


_N = """n as (select doc_id, source as source_id, doc_id % 7 as t, case doc_id % 5 when 0 then 'draft' when 1 then 'stable' when 2 then ' Deprecated ' when 3 then 'wip' end as raw_status,
  case when doc_id % 5 = 0 or doc_id % 10 = 4 then 'draft' when doc_id % 5 = 2 then 'deprecated' else 'stable' end as status, doc_id % 5 <> 3 as known,
  case doc_id % 3 when 0 then 'human-reviewed' when 1 then 'machine-confirmed' else 'unverified' end as trust, doc_id % 9 = 0 as stale, case when doc_id % 2 = 0 then 'about ' else 'old ' end || doc_id as description,
  doc_id % 17 = 0 as locked, doc_id % 6 = 0 as recap, case doc_id % 8 when 0 then '+/' || doc_id || '.md' when 1 then doc_id || '_index.md' when 2 then 'x/' || doc_id || '.md' else 'notes/' || doc_id || '.md' end as path,
  doc_id % 8 in (1, 2) as system, timestamp '2025-06-01 00:00:00' - to_hours((doc_id % 400)::int) as modified from documents),
b as (select *, case when locked then 'locked' when t in (0, 1) then 'raw' when status <> 'draft' then 'not_draft' end as blocked from n)"""


def note_views(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("doc_id", fm.view(F.col("front"), F.lit(NOW).cast("timestamp")).alias("v")).select("doc_id", "v.status", "v.known", "v.trust", "v.stale", "v.intensity", "v.description")


def note_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every source of every note, as a link and as an entry of a record."""
    rows = _notes(spark, d).select("doc_id", "source_id", F.posexplode(fm.source_entries(F.col("front"))).alias("place", "s"))
    kept = fm.ref_entry(F.concat("source_id", F.lit(":"), F.col("s.resource")), F.when(F.col("doc_id") % 2 == 0, F.col("source_id")).otherwise("other"))
    return rows.select("doc_id", "place", "s.resource", "s.title", fm.as_wikilink(F.col("s.resource")).alias("link"), kept["resource"].alias("ref"), kept["title"].alias("ref_title"))


def note_events(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("doc_id", F.explode(fm.verified(F.col("front"))).alias("e")).select("doc_id", "e.by", "e.at")


def browse_listing(spark: SparkSession, d: str) -> DataFrame:
    found = vault.browsed(_notes(spark, d), F.lit(NOW).cast("timestamp"))
    return found.select("source_id", "path", "name", "title", "folder", "type", "summary", "status", "lifecycle", "trust", "stale", "draft", "locked", "system", "approvable", "review", "digest")


def vault_overview(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return vault.overview(vault.browsed(_notes(spark, d), now), now)


def vault_folders(spark: SparkSession, d: str) -> DataFrame:
    return vault.folders(vault.browsed(_notes(spark, d), F.lit(NOW).cast("timestamp")))


def vault_recent(spark: SparkSession, d: str) -> DataFrame:
    return vault.recent(vault.browsed(_notes(spark, d), F.lit(NOW).cast("timestamp"))).select("source_id", "place", "path")


def bulk_approvals(spark: SparkSession, d: str) -> DataFrame:
    return vault.approvals(_notes(spark, d))


def format_conformance(spark: SparkSession, d: str) -> DataFrame:
    return vault.conformance(_notes(spark, d))


def approved_notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as drafts of two spellings, approved: only the front matter's own lines change."""
    mark = F.when(F.col("doc_id") % 3 == 0, "status: draft").when(F.col("doc_id") % 3 == 1, "draft: true").otherwise("status: stable")
    raw = F.concat(F.lit("---\ntype: note\n"), mark, F.lit("\n---\nstatus: draft\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(fm.approved(raw, F.lit("human:ann"), F.lit("2025-06-01"))).alias("text_md5"))


def front_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Front matter written for every document; values that YAML would misread are quoted."""
    i = F.col("doc_id")
    odd = F.when(i % 4 == 0, "on").when(i % 4 == 1, F.concat(F.lit("0"), i.cast("string"))).when(i % 4 == 2, F.lit('say "a: b"\nx: y')).otherwise(F.concat(F.lit("plain-"), i.cast("string")))
    block = fm.yaml_block({"type": (F.lit("note"), "string"), "value": (odd, "string"), "empty": (F.lit(""), "string"), "n": (i, "number"), "tags": (F.array(F.col("lang"), F.lit("b c")), "array"), "by": (F.struct(F.col("source").alias("by")), "map")})
    return table(spark, d, "documents").select("doc_id", block.alias("block"))


def person_names(spark: SparkSession, d: str) -> DataFrame:
    """Names as customers spell their nation's: a full name in three spellings, and its first name alone."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k, full = F.col("c_custkey") % 7, F.concat("n_name", F.lit(" Smith"))
    name = F.when(k == 0, F.lower(full)).when(k == 1, F.upper(full)).when(k == 2, F.col("n_name")).otherwise(full)
    return vault.names(c.join(n, c.c_nationkey == n.n_nationkey).select(name.alias("name")))


def review_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: what waits, what was rejected, and conflicts, by source."""
    i = F.col("doc_id")
    return vault.review_counts(table(spark, d, "documents").select(F.col("source").alias("source_id"), F.when(i % 4 == 0, "draft").when(i % 4 == 1, "rejected").otherwise("accepted").alias("state"), (i % 10 == 0).alias("conflict")))


def catalog_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line a note of all sources in the order of their paths, as many as fit in 20,000 characters."""
    from passagework.queries.composed import _index

    return vault.catalog(_index(spark, d), most=20_000).select("source_id", "path", "summary", F.col("running").cast("long").alias("running"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of their priority's repository, newest first, each with two files."""
    o = table(spark, d, "orders")
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    one = F.concat(F.lit("\x01"), when, F.lit("\0\n"), F.lit("f"), (F.col("o_custkey") % 97).cast("string"), F.lit("\0"), F.lit("g"), (F.col("o_orderkey") % 89).cast("string"), F.lit("\0"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("o_orderdate"), "o_orderkey", one.alias("t"))), asc=False)
    return o.groupBy(F.col("o_orderpriority").alias("source_id")).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "").alias("log"))


def commit_dates(spark: SparkSession, d: str) -> DataFrame:
    return commits.clone_dates(_logs(spark, d))


def snapshot_commit_dates(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as a snapshot's files with recorded times, some of them empty."""
    s = table(spark, d, "supplier")
    files = F.map_from_entries(F.collect_list(F.struct(F.col("s_name").alias("k"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("2025-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"))).alias("v"))))
    sidecars = s.groupBy(F.col("s_nationkey").cast("string").alias("source_id")).agg(F.to_json(F.struct(files.alias("files"))).alias("json"))
    return commits.snapshot_dates(sidecars)


def modified_times(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: the commit's time for most, the file's own for those that were edited since or have none."""
    p = table(spark, d, "part").select(F.lit("s").alias("source_id"), F.col("p_name").alias("path"), F.col("p_partkey").alias("k"))
    first = p.groupBy("source_id", "path").agg(F.min("k").alias("k"))
    files = first.select("source_id", "path", F.lit("2025-05-05 00:00:00").cast("timestamp").alias("mtime"))
    dates = first.where("k % 3 > 0").select("source_id", "path", F.lit("2025-01-01 00:00:00").alias("committed"))
    status = first.groupBy("source_id").agg(F.array_join(F.collect_list(F.when(F.col("k") % 4 == 0, F.concat(F.lit(" M "), F.col("path")))), "\n").alias("status"))
    return commits.modified(files, dates, commits.changed_files(status)).select("path", F.date_format("modified", "yyyy-MM-dd").alias("day"), F.col("committed").isNotNull().alias("known"))


def recorded_dates(spark: SparkSession, d: str) -> DataFrame:
    """A new snapshot of the documents: those of unchanged texts keep their dates, dates of the others were asked for."""
    docs = table(spark, d, "documents")
    key = [F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("path")]
    now = docs.select(*key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    old = docs.where("doc_id % 3 > 0").select(*key, F.sha2(F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.coalesce("text", F.lit(""))), 256).alias("digest"), F.lit("2024-01-01").alias("committed"))
    asked = docs.where("doc_id % 2 = 0").select(*key, F.lit("2025-01-01").alias("committed"))
    return commits.recorded(now, old, asked)


STOP = ["the", "and"]


def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms that may name each source, from the first 20 words of its documents as titles: single words and pairs."""
    docs = table(spark, d, "documents").where("text is not null")
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 20), " ")
    found = labels.ranked_terms(docs, "source", "doc_id", title, STOP)
    return found.where("rank <= 12").select("source", "key", "rank", F.round("raw", 6).alias("score"))


def topic_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 20), " ")
    return labels.names(labels.ranked_terms(docs, "source", "doc_id", title, STOP), "source")


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ten best documents of each question, and the question set: it expects those among them that hold its text."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    best = _bm25(spark, d, 10).join(docs.select("doc_id", "source", "text"), "doc_id").join(bench.select("item_id", F.col("text").alias("asked")), "item_id")
    evidence = best.select("item_id", F.col("item_id").cast("string").alias("qid"), F.col("rank").alias("place"), F.col("source").alias("source_id"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "chat-raw").otherwise("note").alias("kind"), F.col("text").alias("shown"), "asked")
    held = evidence.where(F.contains("shown", F.col("asked"))).groupBy("item_id").agg(F.collect_list(F.struct(F.lit("*").alias("source"), F.regexp_extract("path", r"([0-9]+)\.md$", 1).alias("name"))).alias("expected"))
    none = F.array().cast("array<struct<source:string,name:string>>")
    questions = bench.join(held, "item_id", "left").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"), F.when(F.col("item_id") % 5 == 0, "no").otherwise("yes").alias("answerable"), (F.col("item_id") % 3 == 0).alias("confirmed"), F.coalesce("expected", none).alias("expected"))
    return questions, evidence.where("item_id % 7 > 0").drop("item_id", "asked")


def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rank of the first expected file for each question, 0 if none is found."""
    return evaluation.scored(*_evidence(spark, d)).withColumn("rank", F.coalesce("rank", F.lit(0)))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hits, mean reciprocal rank, false "nothing found", right abstentions and mean sizes of the BM25 search."""
    questions, evidence = _evidence(spark, d)
    text = evidence.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "shown")))["shown"], "\n\n").alias("text"))
    return evaluation.summary(evaluation.scored(questions, evidence), evaluation.payloads(text, evidence, 120, 40))


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Accent-free keys, ids of imported records, names guessed from mails, and moments, of customers."""
    c = table(spark, d, "customer")
    marked = F.translate("c_name", "Cueoas", "Çüéöàş")
    mail = F.concat(F.lit("customer"), F.when(F.col("c_custkey") % 2 == 0, ".").otherwise(""), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("@x.y"))
    names = F.array(F.concat(F.lit("Customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), F.lit("Custom"), F.lit("Customer Anne"))
    touched = F.when(F.col("c_custkey") % 3 == 0, "2025-01-02").when(F.col("c_custkey") % 3 == 1, "2025-01-02T03:04:05Z").otherwise("soon")
    return c.select("c_custkey", plain_key(marked).alias("key"), imported_id(F.lit("s"), F.col("c_name")).alias("record_id"), guessed_name(mail, names).alias("guess"), F.date_format(moment(touched), "yyyy-MM-dd HH:mm:ss").alias("moment"))


QUERIES = {f.__name__: f for f in (
    note_views, note_sources, note_events, browse_listing, vault_overview, vault_folders, vault_recent, bulk_approvals, format_conformance, approved_notes, front_blocks, person_names, review_status, catalog_lines,
    commit_dates, snapshot_commit_dates, modified_times, recorded_dates, topic_terms, topic_names, eval_scores, eval_metrics, text_keys,
)}
_APPROVABLE = "not system and coalesce(blocked, case when recap then 'digest' end) is null"
_REVIEW = "not system and starts_with(path, '+/') and blocked is null"
_SOURCES = """s as (select doc_id, source as source_id, 0 as place, 'src' as resource, null as title from documents where doc_id % 4 = 0 union all select doc_id, source, 0, 'a/b.md', 'T' from documents where doc_id % 4 = 1
  union all select doc_id, source, 1, 'https://x.y/z', null from documents where doc_id % 4 = 1 union all select doc_id, source, 0, '[[Note]]', null from documents where doc_id % 4 = 2)"""
_TERMS = r"""docs as (select source, doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: true)[1:20], ' ') as title from documents where text is not null),
w as (select source, doc_id, list_filter(regexp_extract_all(regexp_replace(lower(replace(title, 'İ', 'i')), '[''’][a-zçğıöşü]+', '', 'g'), '[0-9a-zçğıöşüâîû][0-9a-zçğıöşüâîû\-]*[0-9a-zçğıöşüâîû]'), lambda x: length(x) >= 3 and not regexp_full_match(x, '\d+')) as l from docs),
one as (select source, doc_id, unnest(l) as word, generate_subscripts(l, 1) as i from w), told as (select * from one where word not in ('the', 'and')),
said as (select source, doc_id, strip_accents(replace(word, 'ı', 'i')) as term from told union all
  select a.source, a.doc_id, strip_accents(replace(a.word, 'ı', 'i')) || ' ' || strip_accents(replace(b.word, 'ı', 'i')) from told a join told b on a.doc_id = b.doc_id and a.source = b.source and b.i = a.i + 1),
dd as (select distinct * from said), n as (select count(*) as n from docs), df as (select term, count(*) as df from dd group by 1), size as (select source, count(*) as size from docs group by 1),
c as (select source, term, count(*) as c, any_value(size) as size from dd join size using (source) group by 1, 2 having c >= case when size > 2 then greatest(2, ceil(size * 0.2)) else 1 end),
worst as (select x.source, x.term, max(coalesce(d.df, 0)) as worst from (select source, term, unnest(string_split(term, ' ')) as part from c) x left join df d on d.term = x.part group by 1, 2),
m as (select source, term, c / size * ln(n / df) as raw, worst <= greatest(3, n * 0.1) as rare from c join df using (term) join worst using (source, term), n),
s as (select source, term, raw from (select *, bool_or(rare) over (partition by source) as any_ from m) where rare or not any_),
p as (select s.source, s.term, s.raw, string_split(s.term, ' ') as l from s where contains(s.term, ' ')),
wins as (select p.source, p.term, l from p where not exists (select 1 from s where s.source = p.source and list_contains(l, s.term) and not p.raw >= s.raw * 0.8)),
kept as (select * from s where not contains(term, ' ') and not exists (select 1 from wins where wins.source = s.source and list_contains(wins.l, s.term)) union all select s.* from s join wins using (source, term)),
ranked as (select *, row_number() over (partition by source order by round(raw, 8) desc, term) as rank from kept)"""
_EVIDENCE = f"""{SQL_BM25}, best as (select * from (select *, {_TOP} as rank from scored) where rank <= 10),
e as (select b.item_id, rank as place, source, d.doc_id, case when d.doc_id % 3 = 0 then 'chat-raw' else 'note' end as kind, d.text as shown, q.text as asked from best b join documents d using (doc_id) join benchmark q on q.item_id = b.item_id),
x as (select item_id, doc_id from e where contains(shown, asked)), own as (select * from e where item_id % 7 > 0),
f as (select *, row_number() over (partition by item_id order by place) as file from own),
r as (select item_id, min(file) filter ((item_id, doc_id) in (select (item_id, doc_id) from x)) as rank, count(*) as files, count(*) filter (kind = 'chat-raw' and length(lower(trim(regexp_replace(asked, '\\s+', ' ', 'g')))) >= 12
  and contains(lower(trim(regexp_replace(shown, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(asked, '\\s+', ' ', 'g'))))) as echo from f group by 1),
z as (select b.item_id, case when b.item_id % 5 = 0 then 'no' else 'yes' end as answerable, b.item_id % 3 = 0 as confirmed, files is not null as found, rank, coalesce(files, 0) as files, coalesce(echo, 0) as echo from benchmark b left join r using (item_id))"""
SQL = {
    "note_views": f"with {_N} select doc_id, status, known, trust, stale, '' as intensity, description from n",
    "note_sources": f"""with {_SOURCES} select doc_id, place, resource, title, case when resource in ('src') then '[[src]]' when resource = 'a/b.md' then '[[b]]' else resource end as link,
case when doc_id % 2 = 0 then '/' || resource else source_id || ':' || resource end as ref, case when resource = 'a/b.md' then 'b' when resource = 'https://x.y/z' then 'z' else resource end as ref_title from s""",
    "note_events": "select doc_id, 'human:ann' as by, '2025-01-01' as at from documents where doc_id % 3 = 0 union all select doc_id, 'bot', '' from documents where doc_id % 3 = 1",
    "browse_listing": f"""with {_N} select source_id, path, regexp_replace(string_split(path, '/')[-1], '\\.md$', '') as name, case when doc_id % 3 = 0 then 'Heading ' || doc_id else regexp_replace(string_split(path, '/')[-1], '\\.md$', '') end as title,
case when contains(path, '/') then string_split(path, '/')[1] else '' end as folder, case t when 0 then 'chat-raw' when 1 then 'source' else 'note' end as type, description as summary, coalesce(raw_status, '') as status, status as lifecycle, trust, stale,
status = 'draft' as draft, locked, system, {_APPROVABLE} as approvable, {_REVIEW} as review, recap as digest from b""",
    "vault_overview": f"""with {_N} select source_id, count(*) filter (not system) as total, count(*) filter (system) as system_files, count(*) filter (not system and status = 'draft') as drafts, count(*) filter ({_REVIEW}) as awaiting_review,
count(*) filter (not system and starts_with(path, '+/')) as inbox, count(*) filter (not system and modified >= timestamp '2025-05-25') as changed_lately from b group by 1""",
    "vault_folders": f"""with {_N}, g as (select source_id, case when contains(path, '/') then string_split(path, '/')[1] else '(root)' end as folder, count(*) as n from n where not system group by all)
select *, row_number() over (partition by source_id order by n desc, folder) as place from g""",
    "vault_recent": f"with {_N} select * from (select source_id, row_number() over (partition by source_id order by modified desc, path) as place, path from n where not system and not ends_with(path, '_index.md')) where place <= 12",
    "bulk_approvals": f"with {_N} select source_id, path, coalesce(blocked, case when recap then 'digest' end, 'approved') as outcome from b",
    "format_conformance": f"""with {_N} select count(*) as files, 0::bigint as reserved, 0::bigint as without_type, 0::bigint as without_description, count(*) filter (not known) as unknown_status, count(*) filter (status = 'draft') as drafts,
count(*) filter (doc_id % 10 = 4) as legacy_draft, count(*) filter (doc_id % 4 < 3) as with_sources, count(*) filter (doc_id % 3 < 2) as verified from n""",
    "approved_notes": """select doc_id, case when doc_id % 3 < 2 then md5('---' || chr(10) || 'type: note' || chr(10) || 'status: stable' || chr(10) || 'verified: {"by":"human:ann","at":"2025-06-01"}' || chr(10) || '---' || chr(10) || 'status: draft' || chr(10) || coalesce(text, '')) end as text_md5 from documents""",
    "front_blocks": r"""select doc_id, array_to_string(['---', 'type: note', 'value: ' || case doc_id % 4 when 0 then '"on"' when 1 then '"0' || doc_id || '"' when 2 then '"say \"a: b\"\nx: y"' else 'plain-' || doc_id end, 'n: ' || doc_id, 'tags:',
'  - "' || lang || '"', '  - "b c"', 'by: {"by":"' || source || '"}', '---'], chr(10)) as block from documents""",
    "person_names": """with s as (select n_name, c_custkey % 7 as k from customer join nation on c_nationkey = n_nationkey), u as (select n_name, count(*) as uses, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k > 2) as c from s group by 1)
select lower(n_name) || case when a + b + c > 0 then ' smith' else '' end as key, case when a + b + c = 0 then n_name when c >= a and c >= b and (c > b or n_name || ' Smith' < upper(n_name || ' Smith')) then n_name || ' Smith' when b >= a then upper(n_name || ' Smith') else lower(n_name || ' Smith') end as name, uses from u""",
    "review_status": "select source as source_id, count(*) filter (doc_id % 4 = 0) as pending, count(*) filter (doc_id % 4 = 1) as rejected, count(*) filter (doc_id % 10 = 0) as conflicts from documents group by 1",
    "catalog_lines": """with l as (select source as source_id, doc_id::varchar as path, case when doc_id % 4 = 0 then 'Document ' || doc_id || ' - of ' || n_chars || ' characters in ' || lang else 'Document ' || doc_id end as summary from documents
where length(text) > 0 and (doc_id % 4 = 0 or exists (select 1 from (select unnest(string_split(text, chr(10))) as t) where length(t) > 25 and regexp_matches(t, '\\S'))))
select * from (select *, sum(length(path) + length(summary) + 8) over (order by source_id, path rows unbounded preceding)::bigint as running from l) where running <= 20000""",
    "commit_dates": """with f as (select o_orderpriority as source_id, 'f' || o_custkey % 97 as path, o_orderdate, o_orderkey from orders union all select o_orderpriority, 'g' || o_orderkey % 89, o_orderdate, o_orderkey from orders)
select source_id, path, strftime(max(o_orderdate), '%Y-%m-%d') as committed from f group by all""",
    "snapshot_commit_dates": "select s_nationkey::varchar as source_id, s_name as path, '2025-01-' || lpad((s_suppkey % 28 + 1)::varchar, 2, '0') as committed from supplier where s_suppkey % 5 > 0",
    "modified_times": "select p_name as path, case when min(p_partkey) % 3 > 0 and min(p_partkey) % 4 > 0 then '2025-01-01' else '2025-05-05' end as day, min(p_partkey) % 3 > 0 as known from part group by 1",
    "recorded_dates": """with r as (select source as source_id, doc_id::varchar as path, doc_id % 3 > 0 and (doc_id % 5 > 0 or coalesce(text, '') = 'old') as reused, doc_id from documents)
select source_id, path, case when reused then '2024-01-01' else '2025-01-01' end as committed, reused from r where reused or doc_id % 2 = 0""",
    "topic_terms": f"with {_TERMS} select source, term as key, rank, round(raw, 6) as score from ranked where rank <= 12",
    "eval_scores": f"with {_EVIDENCE} select item_id::varchar as qid, answerable, confirmed, found, coalesce(rank, 0) as rank, files, echo from z",
    "eval_metrics": f"""with {_EVIDENCE}, told as (select sum(length(shown)) as passages, sum(length(shown)) + 2 * (count(*) - 1) + 160 as total from own group by item_id)
select count(*) as questions, count(*) filter (confirmed) as confirmed, count(*) filter (answerable = 'yes') as answerable, count(*) filter (answerable = 'yes' and rank = 1) as hit1, count(*) filter (answerable = 'yes' and rank <= 3) as hit3,
round(avg(coalesce(1 / rank, 0)) filter (answerable = 'yes'), 6) as mrr, count(*) filter (answerable = 'yes' and not found) as false_none, count(*) filter (answerable = 'no') as unanswerable, count(*) filter (answerable = 'no' and not found) as abstained,
count(*) filter (echo > 0) as echo_questions, (select round(avg(total), 6) from told) as payload_mean, (select max(total)::bigint from told) as payload_max, (select round(avg(passages), 6) from told) as passages_mean, (select round(avg(total - passages - 160), 6) from told) as other_mean from z""",
    "text_keys": """select c_custkey, c_name as key, 'imp-' || substr(sha256('s' || chr(10) || c_name), 1, 24) as record_id, 'Customer ' || lpad(c_custkey::varchar, 9, '0') as guess,
case c_custkey % 3 when 0 then '2025-01-02 12:00:00' when 1 then '2025-01-02 03:04:05' end as moment from customer""",
}
