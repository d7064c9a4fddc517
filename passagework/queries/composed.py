"""Queries on composed operators: recall, front matter, digests, work lists, communities, marks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.timeframe import parse
from passagework.operators import review, topics, vectors
from passagework.operators.passages import sections
from passagework.operators.tables import written
from passagework.plans import recall as plan
from passagework.plans.recall import chunked, described, recall, servable
from passagework.sources import notes
from passagework.sources.tables import table
from passagework.streaming.events import advanced, beyond_marks, event_key


def _headed(text):
    """A text with every line of at most 25 characters made a heading."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) <= 25, F.concat(F.lit("## "), x)).otherwise(x)), "\n")


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes with headings, every fourth with a summary, cut into passages."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    return chunked(docs.select(
        F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("of "), F.col("n_chars").cast("string"), F.lit(" characters in "), F.col("lang"))).alias("summary"), _headed(F.col("text")).alias("body"),
    ))


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """The passages as a table, for plans that read them more than once."""
    return written(_index(spark, d))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The records of the notes: kinds, states and dates by the numbers of the documents."""
    i = F.col("doc_id")
    day = lambda n: F.date_add(F.lit("2025-01-01").cast("date"), (i % n).cast("int")).cast("string")
    return table(spark, d, "documents").where("length(text) > 0").select(
        F.col("source").alias("source_id"), i.cast("string").alias("path"), F.when(i % 3 == 0, "chat-raw").otherwise("note").alias("kind"),
        F.when(i % 11 == 0, "draft").when(i % 13 == 0, "rejected").otherwise("accepted").alias("state"), (i % 17 > 0).alias("current"), F.lit(False).alias("pending"),
        F.when(i % 2 == 0, day(60)).alias("created"), F.lit(None).cast("string").alias("dated"), F.when(i % 5 == 0, day(90)).alias("updated"), F.date_add(F.lit("2025-03-01").cast("date"), (i % 20).cast("int")).alias("committed"),
    )


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))


def note_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their title and heading in front, and summaries."""
    return _index(spark, d).select("chunk_id", "heading", F.md5("text").alias("text_md5"))


def recall_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Cited evidence for every question from the passages of all documents: the lexical branch with stems, servable files only, and their records."""
    files = _files(spark, d)
    found = described(recall(_saved(spark, d), _questions(spark, d), eligible=servable(files)), files)
    return found.select("qid", "place", "citation", "heading", F.md5("shown").alias("shown_md5"), "truncated", "state", "kind", F.col("date").cast("string").alias("date"))


def recall_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The same with hashed vectors as a second branch."""
    found = recall(_saved(spark, d), _questions(spark, d), dim=256)
    return found.select("qid", "place", "citation", F.md5("shown").alias("shown_md5"), "truncated")


TODAY = dt.date(2025, 2, 12)


def recall_in_time(spark: SparkSession, d: str) -> DataFrame:
    """The first question with "last week": passages of that week's documents first, then the others."""
    text = table(spark, d, "benchmark").orderBy("item_id").first()["text"]
    found = plan.recall_in_time(_saved(spark, d), _files(spark, d), text + " last week", TODAY)
    return found.select("place", "citation", F.md5("shown").alias("shown_md5"), "truncated", "in_range")


def dated_listing(spark: SparkSession, d: str) -> DataFrame:
    """What happened last week: one passage a note, newest first, raw notes only on days without a written one."""
    index, files = _index(spark, d), _files(spark, d)
    rows = plan.listing(plan.dated(index, files, parse("what did we do last week", TODAY)))
    return rows.select("rank", "source_id", "path", "heading", F.col("day").cast("string").alias("day"), F.md5("text").alias("text_md5"), "truncated")


def listing_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The same question answered within the budget, as a text for a reader."""
    found = plan.recall_in_time(_saved(spark, d), _files(spark, d), "what did we do last week", TODAY)
    return found.select("place", "citation", "truncated", "in_range")


def recall_text(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every question as one text, and how many notes it cites."""
    found = recall(_saved(spark, d), _questions(spark, d))
    cited = plan.sources_of(found).groupBy("qid").agg(F.count(F.lit(1)).alias("notes"))
    return plan.formatted(found).join(cited, "qid").select("qid", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"), "notes")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as notes with front matter of several shapes."""
    docs = table(spark, d, "documents").where("text is not null")
    front = F.concat(
        F.lit("---\ntitle: \"Note "), F.col("doc_id").cast("string"), F.lit("\"\nlang: "), F.col("lang"), F.lit("\nchars: "), F.col("n_chars").cast("string"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nsources: ["), F.col("source"), F.lit(", b]"))).otherwise(F.concat(F.lit("\nsources:\n  - "), F.col("source"), F.lit("\n  - b"))),
        F.lit("\nverified:\n  by: "), F.when(F.col("doc_id") % 3 == 0, "human:ann").otherwise("bot"), F.lit("\ndraft: "), F.when(F.col("doc_id") % 5 == 0, "yes").otherwise("no"), F.lit("\n---\n"))
    return docs.select("doc_id", F.concat(front, F.replace("text", F.lit("\r"), F.lit(""))).alias("content"))


def frontmatter_parse(spark: SparkSession, d: str) -> DataFrame:
    get = lambda p: F.get_json_object("front", p)
    return notes.parsed(_notes(spark, d)).select(
        "doc_id", get("$.title").alias("title"), get("$.lang").alias("lang"), get("$.chars").cast("long").alias("chars"), get("$.sources[0]").alias("first_source"),
        get("$.verified.by").alias("verified_by"), get("$.draft").cast("boolean").alias("draft"), F.md5("body").alias("body_md5"))


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every line of at most 25 characters made a heading, split on them."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", _headed(F.col("text")).alias("text"))
    return sections(docs).select("doc_id", "section_no", "heading", F.md5("body").alias("body_md5"))


def digest_items(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents written as one review digest a source, and its items read back."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    mark = F.when(F.col("quality") == 0, "-").when(F.col("toxic") == 1, " ").otherwise("x")
    one = F.concat(F.lit("- ["), mark, F.lit("] **"), F.col("lang"), F.lit("** document "), F.col("doc_id").cast("string"), F.lit("\n  > has "), F.col("n_chars").cast("string"), F.lit(" characters"))
    page = both.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("t")))).alias("l"))
    text = F.concat(F.lit("# Review\n## "), F.col("source"), F.lit("\n"), F.array_join(F.col("l.t"), "\n"))
    lines = page.select(F.col("source").alias("path"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return review.items(lines).select("path", "line", "section", "tag", "statement", "quote", "decision")


def decisions_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each statement once (the text up to its first line's end, whatever its case), from the first document with it."""
    rows = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.md5(F.lower(F.split("text", "\n")[0])).alias("statement"))
    return review.first_seen(rows, "statement", [F.asc("doc_id")])


def merged_work(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as cards, parts and customers as notes that name a card by code or by number."""
    s = table(spark, d, "supplier")
    cards = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("code"), (F.col("s_suppkey") % 80).cast("int").alias("number"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("due"), F.col("s_acctbal").alias("touched"))
    by_code = table(spark, d, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), F.concat(F.lit("see /c/s"), (F.col("p_partkey") % 150).cast("string")).alias("text"))
    by_number = table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.concat(F.lit("about #"), (F.col("c_custkey") % 120).cast("string")).alias("text"))
    rows = review.merged_cards(cards, by_code.unionByName(by_number))
    return rows.groupBy(F.coalesce("code", F.lit("none")).alias("card"), F.array_join("badges", ",").alias("badges")).agg(F.count(F.lit(1)).alias("n"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    edges = vectors.knn_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 6)
    return topics.communities(edges)


def marks_advance(spark: SparkSession, d: str) -> DataFrame:
    """New turns past each conversation's mark, its newest held back, and the mark after them."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    marks = rows.groupBy("conv_id").agg((F.min("turn") + F.col("conv_id") % 3).alias("done"))
    handled = beyond_marks(rows, marks, "conv_id", "turn")
    n = handled.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return advanced(marks, handled, "conv_id", "turn").join(n, "conv_id", "left").select("conv_id", "done", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", event_key(F.lit("web"), F.col("user_id"), F.col("props")).alias("key"))


QUERIES = {f.__name__: f for f in (note_passages, recall_evidence, recall_hybrid, recall_in_time, dated_listing, listing_evidence, recall_text, frontmatter_parse, heading_sections, digest_items, decisions_first_seen, merged_work, communities, marks_advance, event_keys)}
_TOKEN = r"[\p{L}\p{N}_]{2,}"
_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_PARTS = rf"""l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
parts as (select *, sum((length(t) <= 25)::int) over (partition by doc_id order by n rows unbounded preceding)::bigint as section_no from l),
sections as (select doc_id, section_no, coalesce(nullif(trim(max(t) filter (length(t) <= 25)), ''), 'body') as heading,
  regexp_replace(coalesce(string_agg(t, chr(10) order by n) filter (length(t) > 25), ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') as body from parts group by all)"""
# the passages c (id, source, doc_id, heading, text) of all documents, and their records f
_PASSAGES = f"""{_PARTS}, windows as (
  select doc_id, section_no, heading, unnest(range(0, 1 + greatest(ceil((length(body) - 1100) / 950.0), 0)::bigint)) as k, body from sections where body <> '' and doc_id in (select doc_id from documents where length(text) > 0)),
pieces as (select doc_id, section_no, k, heading, 'Document ' || doc_id || case when heading = 'body' then '' else ' > ' || heading end || chr(10) || substr(body, 1 + 950 * k, 1100) as text from windows
  union all select doc_id, -1, 0, 'summary', 'Document ' || doc_id || ' - of ' || n_chars || ' characters in ' || lang from documents where doc_id % 4 = 0 and length(text) > 0),
numbered as (select *, row_number() over (partition by doc_id order by section_no, k) - 1 as no from pieces),
c as (select source || '#' || doc_id || '#' || lpad(no::varchar, 6, '0') as id, source, doc_id, heading, n.text from numbered n join documents using (doc_id)),
days as (select doc_id, source, case when doc_id % 3 = 0 then 'chat-raw' else 'note' end as kind, case when doc_id % 11 = 0 then 'draft' when doc_id % 13 = 0 then 'rejected' else 'accepted' end as state,
  case when doc_id % 2 = 0 then date '2025-01-01' + (doc_id % 60)::int end as created, case when doc_id % 5 = 0 then date '2025-01-01' + (doc_id % 90)::int end as updated, date '2025-03-01' + (doc_id % 20)::int as committed
  from documents where length(text) > 0),
f as (select *, coalesce(created, updated, committed) as day from days),
ranged as (select *, case when created between date '2025-02-03' and date '2025-02-09' and updated between date '2025-02-03' and date '2025-02-09' then greatest(created, updated)
  when created between date '2025-02-03' and date '2025-02-09' then created when updated between date '2025-02-03' and date '2025-02-09' then updated else day end as in_day from f),
inside as (select * from ranged where in_day between date '2025-02-03' and date '2025-02-09')"""


def _scored(questions: str, shown: str = "true") -> str:
    """BM25 with stems over the passages c for questions (qid, text); ranks go to the passages that may be shown."""
    return f"""words as (select id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from c),
tf as (select id, term, count(*) as tf from (select * from words union all
  select id, substr(term, 1, k::bigint) || '*' from (select *, unnest(range(4, length(term) + 1)) as k from words where length(term) >= 4)) group by all),
sizes as (select id, len(regexp_extract_all(lower(text), '{_TOKEN}')) as n from c), stats as (select count(*)::double as rows_, avg(n) as avg_len from sizes),
questions as ({questions}), spoken as (select qid, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from questions),
asked as (select qid, term, count(*) as times from spoken group by all union all select distinct qid, substr(term, 1, greatest(4, length(term) - 3)) || '*', 1 from spoken where length(term) >= 5),
df as (select term, count(*) as df from tf where term in (select term from asked) group by term),
idf as (select term, avg_len, case when ln((rows_ - df + 0.5) / (df + 0.5)) > 0 then ln((rows_ - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from df, stats),
s as (select qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)) * times), 10) as score from tf join sizes using (id) join idf using (term) join asked using (term) group by all),
found as (select *, row_number() over (partition by qid order by score desc, id) as rank from s join c using (id) join f using (doc_id) where {shown})"""


def _picked(best: str, top_k: int = 6) -> str:
    """The budgeted choice from rows (qid, rank, doc_id, source, text, ...) numbered without gaps."""
    return f"""best as materialized (select *, format('Document {{}} ({{}}:{{}})', doc_id, source, doc_id) as cite, trim(regexp_replace(text, '\\s+', ' ', 'g')) as norm from ({best})),
pick(qid, rank, n, size, norms, cites, cite, shown, truncated, taken) as (
  select qid, 0::bigint, 0, 0::bigint, []::varchar[], []::varchar[], '', '', false, false from (select distinct qid from best)
  union all
  select p.qid, b.rank, p.n + ok::int, p.size + case when ok then length(substr(b.text, 1, (7000 - p.size)::bigint)) else 0 end,
    case when ok then list_append(p.norms, b.norm) else p.norms end, case when ok then list_append(p.cites, b.cite) else p.cites end,
    b.cite, substr(b.text, 1, (7000 - p.size)::bigint), length(b.text) > 7000 - p.size, ok
  from pick p join best b on b.qid = p.qid and b.rank = p.rank + 1,
  lateral (select p.n < {top_k} and not list_contains(p.norms, b.norm) and len(list_filter(p.cites, lambda x: x = b.cite)) < 2 and not (p.size + length(b.text) > 7000 and p.n > 0) as ok))"""


_ALL = "select item_id::varchar as qid, text from benchmark"
_ONE = "select text from benchmark order by item_id limit 1"
_LISTED = f"""with recursive {_PASSAGES}, dated as (select c.*, i.kind, in_day from c join inside i using (doc_id)),
told as (select * from dated where kind = 'note' or in_day not in (select in_day from dated where kind = 'note')),
firsts as (select *, row_number() over (partition by source, doc_id order by in_day desc, regexp_matches(heading, '^[0-9]{{4}}') desc, heading = 'summary' desc, id) as r from told),
ordered as (select source, doc_id, heading, in_day, case when length(text) <= 600 then text when contains(substr(text, 1, 600), ' ') then regexp_extract(substr(text, 1, 600), '(?s)^(.*) ', 1) || ' …' else substr(text, 1, 600) || ' …' end as text,
  length(text) > 600 as cut, row_number() over (order by in_day desc, kind = 'note' desc, doc_id::varchar desc, source desc) as rank from firsts where r = 1)"""
SQL = {
    "note_passages": f"with {_PASSAGES} select id as chunk_id, heading, md5(text) as text_md5 from c",
    "recall_evidence": f"""with recursive {_PASSAGES}, {_scored(_ALL, "state = 'accepted' and doc_id % 17 > 0")}, {_picked("select * from found where rank <= 18")}
select qid, n as place, p.cite as citation, b.heading, md5(shown) as shown_md5, truncated, b.state, b.kind, b.day::varchar as date from pick p join best b using (qid, rank) where taken""",
    "recall_in_time": f"""with recursive {_PASSAGES}, {_scored(f"select 'near' as qid, ({_ONE}) as text union all select 'far', ({_ONE}) || ' last week'")},
near as (select *, row_number() over (order by score desc, id) as r from found where qid = 'near' and doc_id in (select doc_id from inside)),
both_ as (select *, true as in_range from near where r <= 18 union all select *, rank as r, false as in_range from found where qid = 'far' and rank <= 18 and id not in (select id from near where r <= 18)),
lined as (select * exclude (qid, rank), 'q' as qid, row_number() over (order by in_range desc, r, id) as rank from both_), {_picked("select * from lined")}
select n as place, p.cite as citation, md5(shown) as shown_md5, truncated, b.in_range from pick p join best b using (qid, rank) where taken""",
    "dated_listing": f"{_LISTED} select rank, source as source_id, doc_id::varchar as path, heading, in_day::varchar as day, md5(text) as text_md5, cut as truncated from ordered",
    "listing_evidence": f"""{_LISTED}, {_picked("select 'q' as qid, * from ordered", 12)} select n as place, cite as citation, truncated, true as in_range from pick where taken""",
    "recall_text": f"""with recursive {_PASSAGES}, {_scored(_ALL)}, {_picked("select * from found where rank <= 18")},
heads as (select *, row_number() over (partition by qid, cite order by n) = 1 as first from pick where taken)
select qid, md5(string_agg(case when first then '# ' || cite || chr(10) else '' end || shown || case when truncated then ' …' else '' end, chr(10) || chr(10) order by n)) as text_md5,
length(string_agg(case when first then '# ' || cite || chr(10) else '' end || shown || case when truncated then ' …' else '' end, chr(10) || chr(10) order by n)) as chars, count(*) filter (first) as notes from heads group by qid""",
    "frontmatter_parse": """select doc_id, 'Note ' || doc_id as title, lang, n_chars as chars, source as first_source, case when doc_id % 3 = 0 then 'human:ann' else 'bot' end as verified_by,
doc_id % 5 = 0 as draft, md5(replace(text, chr(13), '')) as body_md5 from documents where text is not null""",
    "heading_sections": f"with {_PARTS} select doc_id, section_no, heading, md5(body) as body_md5 from sections where body <> ''",
    "digest_items": """select source as path, (1 + 2 * row_number() over (partition by source order by doc_id) - 1)::int as line, source as section, lang as tag, 'document ' || doc_id as statement, 'has ' || n_chars || ' characters' as quote,
case when quality = 0 then 'rejected' when toxic = 1 then 'open' else 'accepted' end as decision from documents join labels using (doc_id)""",
    "decisions_first_seen": "select min(doc_id) as doc_id, statement from (select doc_id, md5(lower(string_split(text, chr(10))[1])) as statement from documents where length(text) > 0) group by statement",
    "merged_work": """with cards as (select 's' || s_suppkey as code, s_suppkey % 80 as number from supplier), single as (select number, min(code) as code from cards group by 1 having count(*) = 1),
o as (select 'part' as origin, 's' || p_partkey % 150 as code, null as num from part union all select 'customer', null, c_custkey % 120 from customer),
m as (select origin, coalesce(c.code, s.code) as card from o left join cards c on c.code = o.code left join single s on s.number = o.num),
b as (select card, string_agg(distinct origin, ',' order by origin) as badges from m where card is not null group by 1)
select code as card, 'card' || coalesce(',' || badges, '') as badges, count(*) as n from cards left join b on card = code group by all
union all select 'none', origin, count(*) from m where card is null group by all""",
    "marks_advance": """with m as (select conv_id, min(turn) + conv_id % 3 as done, max(turn) as last from conversations group by 1),
h as (select c.conv_id, max(turn) as t, count(*) as n from conversations c join m using (conv_id) where turn > done and turn < last group by 1)
select m.conv_id, greatest(done, coalesce(t, done)) as done, coalesce(n, 0) as n from m left join h using (conv_id)""",
    "event_keys": """select event_id, sha256('["web", "' || user_id || '", "' || replace(props, '"', chr(92) || '"') || '"]') as key from events""",
}
