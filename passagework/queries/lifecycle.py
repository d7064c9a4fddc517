"""Queries on gates, extraction and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.marker import marked, same_but_for_marker
from passagework.operators import gates, ledger, threads
from passagework.queries.search import _TOP, SQL_BM25, _bm25
from passagework.sources.tables import table


def _share_of_vowels():
    """A stand-in for a cross-encoder: the share of a text's characters that are an e."""
    return lambda questions, texts: [t.count("e") / max(len(t), 1) for t in texts]


gates.register("vowels", _share_of_vowels)


def rerank_gate(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of each question, reordered by a scorer and cut at its threshold."""
    best = _bm25(spark, d, 20).select("item_id", "doc_id", "rank")
    rows = best.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("question", F.lit(""))
    scored = gates.scored(rows, "question", "text", gates.provider("vowels"))
    return gates.reranked(scored, "item_id", ["doc_id"], 0.1).select("item_id", "doc_id", "rank", F.round("gate_score", 6).alias("gate_score"))


def judge_gate(spark: SparkSession, d: str) -> DataFrame:
    """Line items as judged passages: their discount says injection, their tax relevance; those returned are secret."""
    li = table(spark, d, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_tax") * 10).alias("relevance"), F.lit(0.5).alias("best"), (F.col("l_discount") * 10).alias("injection"), (F.col("l_returnflag") == "R").alias("secret"))
    return gates.judged(rows).groupBy("judged", "secret").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


def extracted_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations packed into parts; a stand-in extractor makes an item of each part's first line; quotes are verified."""
    turns = table(spark, d, "conversations").where("text is not null")
    x = threads.exchanges(turns)
    parts = threads.packed(turns, "conv_id", "turn", F.length("text") + 24, 4000).join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    joined = parts.groupBy("conv_id", "part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("text"))
    found = gates.extracted(joined, "conv_id", "part", "text", lambda: lambda t: [{"type": "fact", "statement": t.split("\n")[0], "quote": t.split("\n")[0], "exchange": 1}])
    items = found.withColumn("item_id", F.col("conv_id") * 1000 + F.col("part"))
    places = threads.verified_quotes(items, x)
    return gates.verified_items(items, places).select("item_id", F.md5("statement").alias("statement_md5"), "i", "speaker")


def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a ledger of the years before 1998, all orders delivered again: each is there once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey")
    old = table(spark, d, "orders").where("year(o_orderdate) < 1998").select(F.col("o_orderkey").alias("event_id"), "o_custkey")
    return ledger.appended(old, o.unionByName(o))


def decisions_apply(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records, their line items as requests that name a revision and a state."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 3).cast("int").alias("revision"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("accepted").alias("state"))
    req = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("record_id"), (F.col("l_orderkey") % 2).cast("int").alias("expected_revision"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("state"))
    return ledger.decided(o, req)


def superseded_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records of one revision, corrected by the suppliers that share their key; the current revisions."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit(1).alias("revision"), F.col("p_name").alias("content"), F.lit("accepted").alias("state"), F.lit(True).alias("current"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("content"))
    return ledger.current(ledger.superseded(p, s)).select("record_id", "revision", "state", "content")


def marker_digests(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes, every third with front matter, marked as replaced; every fifth is edited afterwards and no longer matches."""
    i, record = F.col("doc_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string"))
    raw = F.concat(F.when(i % 3 == 0, "---\ntitle: note\n---\n").otherwise(""), F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw")).withColumn("marked", marked(F.col("raw"), record))
    now = F.concat("marked", F.when(i % 5 == 0, "!").otherwise(""))
    return rows.select("doc_id", F.md5("marked").alias("marked_md5"), same_but_for_marker(now, record, F.sha2(F.col("raw").cast("binary"), 256)).alias("same"))


QUERIES = {f.__name__: f for f in (marker_digests, rerank_gate, judge_gate, extracted_items, ledger_append, decisions_apply, superseded_records)}
SQL = {
    "marker_digests": """select doc_id, md5('---' || chr(10) || case when doc_id % 3 = 0 then 'title: note' || chr(10) else '' end || 'superseded_by: r' || doc_id || chr(10) || '---' || chr(10) || coalesce(text, '')) as marked_md5, doc_id % 5 <> 0 as same from documents""",
    "extracted_items": r"""with recursive c as (select * from conversations where text is not null), s as (select conv_id, turn, text, length(text) + 24 as n, row_number() over (partition by conv_id order by turn) as r from c),
p(conv_id, turn, text, r, used, part) as (select conv_id, turn, text, r, n, 0 from s where r = 1
 union all select s.conv_id, s.turn, s.text, s.r, case when used + n <= 4000 then used + n else n end, case when used + n <= 4000 then part else part + 1 end from p join s on s.conv_id = p.conv_id and s.r = p.r + 1),
i as (select conv_id, conv_id * 1000 + part as item_id, string_split(string_agg(text, chr(10) order by turn, text), chr(10))[1] as t from p group by conv_id, part),
n as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn, role rows unbounded preceding)::bigint as i from c),
x as (select conv_id, i, arg_max(text, turn) filter (role = 'user') as u, coalesce(arg_max(text, turn) filter (role = 'assistant'), '') as a from n where i > 0 group by all),
said as (select conv_id, i, 0 as who, lower(trim(regexp_replace(u, '\s+', ' ', 'g'))) as t from x union all select conv_id, i, 1, lower(trim(regexp_replace(a, '\s+', ' ', 'g'))) from x),
h as (select item_id, i.t as statement, said.i, who, row_number() over (partition by item_id order by said.i <> 1, said.i, who) as r from i join said on said.conv_id = i.conv_id and trim(regexp_replace(i.t, '\s+', ' ', 'g')) <> '' and contains(said.t, lower(trim(regexp_replace(i.t, '\s+', ' ', 'g'))))),
f as (select *, row_number() over (partition by lower(trim(statement)) order by item_id) as k from h where r = 1)
select item_id, md5(statement) as statement_md5, i, case when who = 0 then 'owner' else 'assistant' end as speaker from f where k = 1""",
    "rerank_gate": f"""with {SQL_BM25}, best as (select item_id, doc_id, {_TOP} as rank from scored), g as (
select item_id, doc_id, rank, (length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1) as s from best join documents using (doc_id) where rank <= 20)
select item_id, doc_id, row_number() over (partition by item_id order by round(s, 10) desc, rank, doc_id) as rank, round(s, 6) as gate_score from g where s > 0.1""",
    "judge_gate": """select secret is false as judged, secret, count(*) as n, sum(l_partkey)::bigint as parts from (select *, l_returnflag = 'R' as secret from lineitem)
where secret or (l_discount * 10 <= 0.7 and l_tax * 10 >= 0.5) group by all""",
    "ledger_append": "select o_orderkey as event_id, o_custkey from orders",
    "decisions_apply": """with r as (select l_orderkey as record_id, count(distinct l_returnflag = 'R') as states, bool_or(l_returnflag = 'R') as bad from lineitem where l_linenumber <= 2 group by 1),
b as (select o_orderkey as record_id, o_orderkey % 3 as revision, case when o_orderstatus = 'O' then 'draft' else 'accepted' end as state, states, case when bad then 'rejected' else 'accepted' end as wanted
from orders left join r on o_orderkey = record_id),
o as (select *, case when states is null then 'none' when states > 1 then 'conflict' when record_id % 2 <> revision then 'stale' when state <> 'draft' then 'settled' else 'done' end as outcome from b)
select record_id, case when outcome = 'done' then wanted else state end as state, (case when outcome = 'done' then revision + 1 else revision end)::int as revision, outcome from o""",
    "superseded_records": """select p_partkey as record_id, case when s_suppkey is null then 1 else 2 end as revision, 'accepted' as state, coalesce(s_name, p_name) as content from part left join supplier on s_suppkey = p_partkey""",
}
