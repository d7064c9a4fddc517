"""Queries on passages: windows, tokens, BM25, fusion, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.text import MASK, SECRETS, masked_with_kinds, normalised, prefix_stem, tokens
from passagework.operators import lexical, passages, ranking, vectors
from passagework.sources.tables import table

TOKEN = r"[\p{L}\p{N}_]{2,}"


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return passages.windows(table(spark, d, "documents").select("doc_id", "text"))


SQL_CHUNKS = """
chunks as (
  select doc_id, i::int as chunk_no, substr(text, 1 + 950 * i, 1100) as chunk_text
  from (select doc_id, text, unnest(range(0, 1 + greatest(ceil((length(text) - 1100) / 950.0), 0)::bigint)) as i from documents where length(text) > 0)
)"""


def tokens_tf(spark: SparkSession, d: str) -> DataFrame:
    return passages.postings(table(spark, d, "documents"), ["doc_id"], "text")


def tokens_df(spark: SparkSession, d: str) -> DataFrame:
    return tokens_tf(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


SQL_TF = f"""
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from documents) group by all)"""


def postings_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """For each question stem: how many documents have a word that begins with it, and how many such words."""
    posted = tokens_tf(spark, d)
    stems = passages.query_prefixes(table(spark, d, "benchmark"), "item_id", "text")
    found = posted.join(passages.prefix_matches(posted, stems), "term")
    each = found.groupBy("stem", "doc_id").agg(F.sum("tf").alias("tf"))
    return each.groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


SQL_STEMS = f"""
words as (select distinct item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from benchmark),
stems as (select distinct item_id, substr(term, 1, greatest(4, length(term) - 3)) as stem from words where length(term) >= 5)"""


def _bm25(spark: SparkSession, d: str, n: int, among: DataFrame | None = None, prefixes: bool = False) -> DataFrame:
    asked = passages.query_terms(table(spark, d, "benchmark"), "item_id", "text", prefixes)
    return lexical.best(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", asked, "item_id", n, among)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("raw", 6)).drop("raw")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_bm25(spark, d, 20))


def bm25_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The same, where words of five or more characters ask for their stems as well."""
    return _shown(_bm25(spark, d, 20, prefixes=True))


def bm25_scoped_after_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Statistics cover all documents; the scope, and then the limit, come after the scores."""
    scope = table(spark, d, "documents").where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")
    return _shown(_bm25(spark, d, 5, scope).join(scope, "doc_id"))


SQL_BM25 = f"""{SQL_TF},
sizes as (select doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) as n from documents where text is not null),
stats as (select count(*)::double as rows_, avg(n) as avg_len from sizes),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from benchmark) group by all),
df as (select term, count(*) as df from tf where term in (select term from asked) group by term),
idf as (select term, avg_len, case when ln((rows_ - df + 0.5) / (df + 0.5)) > 0 then ln((rows_ - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from df, stats),
scored as (
  select item_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)) * times) as raw, round(raw, 10) as score
  from tf join sizes using (doc_id) join idf using (term) join asked using (term) group by item_id, doc_id)"""
# tokens answer to their own name and to the stems that they begin with
SQL_BM25_PREFIXES = SQL_BM25.replace(SQL_TF, f"""
words as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from documents),
tf as (select doc_id, term, count(*) as tf from (select * from words union all
  select doc_id, substr(term, 1, k::bigint) || '*' from (select *, unnest(range(4, length(term) + 1)) as k from words where length(term) >= 4)) group by all)""").replace(
    "from benchmark) group by all)", f"""from benchmark) group by all
  union all select distinct item_id, substr(term, 1, greatest(4, length(term) - 3)) || '*', 1 from (select item_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from benchmark) where length(term) >= 5)""", 1)


def unmatched_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of three or more characters of each question that no document has, the first twelve in order."""
    asked = table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" zzunmatched")).alias("question"))
    return passages.unmatched(asked, table(spark, d, "documents").where("text is not null"), "item_id", "question", "text")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is a multiple of 50 the best 20 others, then the score floor."""
    rows = table(spark, d, "embeddings")
    found = vectors.nearest(rows.where(F.col("vec_id") % 50 == 0), rows, "vec_id", "embedding", 20)
    return found.where("score >= 0.2").select("query_id", "vec_id", "rank", F.round("raw", 4).alias("score"))


def knn_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges to the six nearest with a positive score; a pair keeps the larger weight."""
    return vectors.knn_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 6).select("a", "b", F.round("raw", 4).alias("weight"))


SQL_COS = """
v as (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) + 1e-9 as n from embeddings),
scores as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) / (q.n * v.n) as raw, round(raw, 10) as score
  from v q join v on q.vec_id <> v.vec_id {where}),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)"""


def mean_vector_per_label(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fuse the BM25 branch with a branch of rare shared words, per question."""
    asked = passages.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    index = lexical.indexed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", asked)
    first, second = lexical.best_in(index, asked, "item_id", 20), lexical.most_shared(index, asked, "item_id", 20)
    return ranking.fused([second, first], ["doc_id"], 18, "item_id").select("item_id", "doc_id", "rank", F.round("raw", 6).alias("rrf"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hash_embedding(table(spark, d, "documents"), "doc_id", "text", 256)


def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for each question from its 18 best passages: 6 texts, 7000 characters, 2 a source."""
    docs = table(spark, d, "documents")
    best = _bm25(spark, d, 18)
    rows = best.join(docs.select("doc_id", "source", "text"), "doc_id")
    return ranking.within_budget(rows, "item_id", "rank", "source", "text", 6, 7000, 2).select("item_id", "place", "source", F.md5("shown").alias("shown_md5"), "truncated")


def catalog_cut(spark: SparkSession, d: str) -> DataFrame:
    """One line a document of each source, cut where the running size of path and summary passes 120,000."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, 300).alias("summary"))
    size = F.length(F.col("doc_id").cast("string")) + F.length("summary") + 8
    return ranking.within_running_size(rows, ["source"], "doc_id", size, 120_000).select("source", "doc_id", "summary", "running")


def dedup_normalised(spark: SparkSession, d: str) -> DataFrame:
    """First document of each text that is equal after lower-casing and squeezing white space."""
    rows = table(spark, d, "documents").select("doc_id", F.md5(normalised(F.coalesce("text", F.lit("")))).alias("norm"))
    return rows.groupBy("norm").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def pool_variants(spark: SparkSession, d: str) -> DataFrame:
    """Pool a question's own best documents with those of its last words; first seen wins, at most 32."""
    bench = table(spark, d, "benchmark")
    asked = passages.query_terms(bench, "item_id", "text")
    tail = bench.select("item_id", F.explode(F.slice(F.reverse(tokens(F.col("text"))), 1, 6)).alias("term")).distinct()
    index = lexical.indexed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", asked)
    own = lexical.best_in(index, asked, "item_id", 20).select("item_id", "doc_id", "rank", F.lit(0).alias("variant"))
    other = lexical.most_shared(index, tail, "item_id", 20, repeats=True).select("item_id", "doc_id", "rank", F.lit(1).alias("variant"))
    return ranking.pooled(own.unionByName(other), "item_id", ["doc_id"], "variant", "rank", 32).select("item_id", "doc_id", "variant", "rank", "place")


def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", masked_with_kinds(F.coalesce("text", F.lit(""))).alias("found"))
    return rows.select("doc_id", F.md5("found.text").alias("masked_md5"), F.array_join("found.kinds", ",").alias("kinds"))


def _sql_mask() -> tuple[str, str]:
    text, kinds = "coalesce(text, '')", []
    for kind, p in SECRETS:
        kinds.append(f"case when regexp_matches({text}, '{p}') then '{kind}' end")
        text = f"regexp_replace({text}, '{p}', '{MASK}', 'g')"
    return text, f"concat_ws(',', {', '.join(kinds)})"


def label_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """The twelve words that mark each source most: class frequency by size times log of inverse document frequency."""
    docs = table(spark, d, "documents").where("text is not null")
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    words = docs.select("source", "doc_id", F.explode(F.array_distinct(tokens(F.col("text"), 4))).alias("term"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    cf = words.groupBy("source", "term").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    raw = F.col("c") / F.col("size") * F.log(F.col("n_docs") / F.col("df"))
    scored = cf.join(df, "term").join(size, "source").join(F.broadcast(n)).select("source", "term", raw.alias("raw"), F.round(raw, 8).alias("score"))
    return ranking.top(scored, ["source"], [F.desc("score"), F.asc("term")], 12).select("source", "term", "rank", F.round("raw", 6).alias("score"))


def line_idf_best_match(spark: SparkSession, d: str) -> DataFrame:
    """For each question the line of its best document whose words weigh most, a word weighing 1 / lines with it."""
    best = _bm25(spark, d, 1).select("item_id", "doc_id")
    asked = best.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    found = passages.best_lines(asked, table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id", "question", "text")
    return found.select("item_id", "doc_id", "line", F.round("raw", 5).alias("score"))


QUERIES = {f.__name__: f for f in (
    chunk_windows, tokens_tf, tokens_df, postings_prefix_match, bm25_topk, bm25_prefixes, bm25_scoped_after_scoring, unmatched_terms, cosine_topk, knn_graph_edges,
    mean_vector_per_label, rrf_fusion, hash_embedding, budget_select, catalog_cut, dedup_normalised, pool_variants, mask_secrets, label_tfidf,
    line_idf_best_match,
)}
_MASKED, _KINDS = _sql_mask()
_TOP = "row_number() over (partition by item_id order by score desc, doc_id)"
SQL = {
    "chunk_windows": f"with {SQL_CHUNKS} select * from chunks",
    "tokens_tf": f"with {SQL_TF} select * from tf",
    "tokens_df": f"with {SQL_TF} select term, count(*) as df, sum(tf)::bigint as cf from tf group by term",
    "postings_prefix_match": f"""with {SQL_TF}, {SQL_STEMS},
each as (select stem, doc_id, sum(tf) as tf from tf join (select distinct stem from stems) s on starts_with(term, stem) group by all)
select stem, count(*) as df, sum(tf)::bigint as cf from each group by stem""",
    "bm25_topk": f"with {SQL_BM25} select item_id, doc_id, round(raw, 6) as score, rank from (select *, {_TOP} as rank from scored) where rank <= 20",
    "bm25_prefixes": f"with {SQL_BM25_PREFIXES} select item_id, doc_id, round(raw, 6) as score, rank from (select *, {_TOP} as rank from scored) where rank <= 20",
    "bm25_scoped_after_scoring": f"""with {SQL_BM25} select item_id, doc_id, source, round(raw, 6) as score, rank
from (select *, {_TOP} as rank from scored join documents using (doc_id) where source in ('src1', 'src2', 'src3')) where rank <= 5""",
    "unmatched_terms": r"""with vocabulary as (select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents),
w as (select item_id, list_append(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}'), 'zzunmatched') as l from benchmark),
asked as (select item_id, term, min(pos) as pos from (select item_id, unnest(l) as term, generate_subscripts(l, 1) as pos from w) group by all),
missing as (select *, row_number() over (partition by item_id order by pos) as rank from asked where term not in (select term from vocabulary))
select item_id, rank, term from missing where rank <= 12""",
    "cosine_topk": f"with {SQL_COS.format(where='where q.vec_id % 50 = 0')} select query_id, vec_id, rank, round(raw, 4) as score from ranked where rank <= 20 and score >= 0.2",
    "knn_graph_edges": f"""with {SQL_COS.format(where='')} select least(query_id, vec_id) as a, greatest(query_id, vec_id) as b, round(max(raw), 4) as weight
from ranked where rank <= 6 and score > 0 group by all""",
    "mean_vector_per_label": """with u as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
m as (select label, pos, avg(x) as x from u group by all)
select label, pos::int as pos, round(x / (sqrt(sum(x * x) over (partition by label)) + 1e-9), 6) as value from m""",
    "rrf_fusion": f"""with {SQL_BM25}, lexical as (select item_id, doc_id, {_TOP} as rank from scored),
shared as (select item_id, doc_id, count(*) as score from tf join asked using (term) group by all), second as (select item_id, doc_id, {_TOP} as rank from shared),
f as (select item_id, doc_id, sum(1 / (60.0 + rank)) as raw, round(raw, 10) as rrf from (select * from lexical where rank <= 20 union all select * from second where rank <= 20) group by all)
select item_id, doc_id, rank, round(raw, 6) as rrf from (select *, row_number() over (partition by item_id order by rrf desc, doc_id) as rank from f) where rank <= 18""",
    "budget_select": rf"""with recursive {SQL_BM25}, best as materialized (
  select item_id, rank, source, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as norm
  from (select *, {_TOP} as rank from scored) join documents using (doc_id) where rank <= 18),
pick(item_id, rank, n, size, norms, sources, source, shown, truncated, taken) as (
  select item_id, 0::bigint, 0, 0::bigint, []::varchar[], []::varchar[], '', '', false, false from (select distinct item_id from best)
  union all
  select p.item_id, b.rank, p.n + ok::int, p.size + case when ok then length(substr(b.text, 1, (7000 - p.size)::bigint)) else 0 end,
    case when ok then list_append(p.norms, b.norm) else p.norms end, case when ok then list_append(p.sources, b.source) else p.sources end,
    b.source, substr(b.text, 1, (7000 - p.size)::bigint), length(b.text) > 7000 - p.size, ok
  from pick p join best b on b.item_id = p.item_id and b.rank = p.rank + 1,
  lateral (select p.n < 6 and not list_contains(p.norms, b.norm) and len(list_filter(p.sources, lambda x: x = b.source)) < 2
    and not (p.size + length(b.text) > 7000 and p.n > 0) as ok))
select item_id, n as place, source, md5(shown) as shown_md5, truncated from pick where taken""",
    "catalog_cut": r"""with l as (select source, doc_id, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 300) as summary from documents),
r as (select *, sum(length(doc_id::varchar) + length(summary) + 8) over (partition by source order by doc_id rows unbounded preceding)::bigint as running from l)
select * from r where running <= 120000""",
    "dedup_normalised": r"""select md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) as norm, min(doc_id) as doc_id, count(*) as copies from documents group by 1""",
    "pool_variants": f"""with {SQL_BM25}, own as (select item_id, doc_id, {_TOP} as rank, 0 as variant from scored),
tail as (select distinct item_id, unnest(list_reverse(regexp_extract_all(lower(text), '{TOKEN}'))[1:6]) as term from benchmark),
hits as (select item_id, doc_id, sum(tf) as score from tf join tail using (term) group by all), other as (select item_id, doc_id, {_TOP} as rank, 1 as variant from hits),
first as (select *, row_number() over (partition by item_id, doc_id order by variant, rank) as f from (select * from own where rank <= 20 union all select * from other where rank <= 20))
select item_id, doc_id, variant, rank, place from (select *, row_number() over (partition by item_id order by variant, rank, doc_id) as place from first where f = 1) where place <= 32""",
    "mask_secrets": f"select doc_id, md5({_MASKED}) as masked_md5, {_KINDS} as kinds from documents",
    "label_tfidf": r"""with words as (select distinct source, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) as term from documents where text is not null),
df as (select term, count(*) as df from words group by 1 having count(*) >= 2), cf as (select source, term, count(*) as c from words group by all having count(*) >= 2),
size as (select source, count(*) as size from documents where text is not null group by 1),
r as (select source, term, c / size * ln((select count(*) from documents where text is not null) / df) as raw from cf join df using (term) join size using (source)),
s as (select *, round(raw, 8) as score from r)
select source, term, rank, round(raw, 6) as score from (select *, row_number() over (partition by source order by score desc, term) as rank from s) where rank <= 12""",
    "line_idf_best_match": rf"""with {SQL_BM25}, best as (select item_id, doc_id from (select *, {_TOP} as rank from scored) where rank = 1),
l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where doc_id in (select doc_id from best)),
w as (select distinct doc_id, line, substr(x, 1, 5) as stem from (select doc_id, line, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{4,}}')) as x from l)),
weight as (select doc_id, stem, 1 / count(*) as w from w group by all),
ask as (select distinct item_id, substr(x, 1, 5) as stem from (select item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{4,}}')) as x from benchmark)),
s as (select item_id, doc_id, line, sum(weight.w) as raw, round(raw, 8) as score from w join weight using (doc_id, stem) join best using (doc_id) join ask using (item_id, stem) group by all)
select item_id, doc_id, line::int as line, round(raw, 5) as score from (select *, row_number() over (partition by item_id order by score desc, line) as rank from s) where rank = 1""",
}
