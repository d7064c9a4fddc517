"""Passages of documents, and the statistics of a lexical index over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import prefix_stem, stems, tokens
from passagework.operators import ranking

CHUNK, OVERLAP = 1100, 150
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Asked terms are broadcast up to this many (some tens of megabytes), else joined by a shuffle.
ASKED_TERMS = 500_000


def windows(docs: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns of docs but the text, with chunk_no and chunk_text: windows of `size` characters.

    Each begins size - overlap after the one before; the one that reaches the end is the last. Empty text has none.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    placed = docs.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    cut = F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size))
    return placed.withColumn("chunk_text", cut).drop(text)


#: Where Markdown is split: before a line of one to six number signs and more behind them.
_BEFORE_HEADING = r"(?md)^(?=#{1,6}[ \t\x0B\f\r]+[^\n]*$)"
_HEADING_LINE = r"^#{1,6}[ \t\x0B\f\r]+[^\n]*"


def _parts(text: Column) -> Column:
    """array<struct<no, heading, body>> of a Markdown text: what stands before the first heading is 0, each heading counts on."""
    parts = F.filter(F.split(text, _BEFORE_HEADING, -1), lambda x: x != "")
    first = F.when(F.element_at(parts, 1).rlike(_HEADING_LINE), 1).otherwise(0)
    line = lambda x: F.regexp_extract(x, _HEADING_LINE, 0)
    return F.when(F.size(parts) > 0, F.transform(parts, lambda x, i: F.struct(
        (first + i).cast("long").alias("no"), F.nullif(F.trim(F.regexp_replace(line(x), "^#+", "")), F.lit("")).alias("heading"), _stripped(F.regexp_replace(x, _HEADING_LINE, "")).alias("body"),
    ))).otherwise(F.array().cast("array<struct<no:bigint,heading:string,body:string>>"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Split Markdown on headings: (columns of docs without the text, section_no, heading, body), blank bodies left out.

    A text is split inside its row, so repeated rows stay apart and nothing is shuffled. A section without a heading
    is called "body"; null text has none.
    """
    own = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.explode(_parts(F.col(f"`{text}`"))).alias("_part"))
    return rows.where("_part.body <> ''").select("_row.*", F.col("_part.no").alias("section_no"), F.coalesce("_part.heading", F.lit("body")).alias("heading"), F.col("_part.body").alias("body"))


def passages_of(notes: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(columns of notes without summary and body, chunk_no, heading, text) of notes (title, summary, body, ...).

    The summary is a passage of its own, "title - summary" under the heading "summary"; then every section's windows,
    each with its title and heading in front, so that a passage says where it comes from. All of it happens in the row.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    kind = "array<struct<heading:string,text:string>>"
    passage = lambda heading, text: F.struct(heading.alias("heading"), text.alias("text"))

    def windowed(part: Column) -> Column:
        label = F.coalesce(part["heading"], F.lit("body"))
        context = F.when(label == "body", F.col("title")).otherwise(F.concat(F.col("title"), F.lit(" > "), label))
        last = F.greatest(F.ceil((F.length(part["body"]) - size) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: passage(label, F.concat(context, F.lit("\n"), F.substring(part["body"], k * step + 1, F.lit(size)))))

    full = F.filter(_parts(F.col("body")), lambda x: x["body"] != "")
    summary = F.coalesce(F.col("summary"), F.lit(""))
    head = F.when(summary != "", F.array(passage(F.lit("summary"), F.concat("title", F.lit(" - "), summary)))).otherwise(F.array().cast(kind))
    every = F.concat(head, F.coalesce(F.flatten(F.transform(full, windowed)), F.array().cast(kind)))
    own = [c for c in notes.columns if c not in ("summary", "body")]
    return notes.select(*own, F.posexplode(every).alias("chunk_no", "_p")).select(*own, "chunk_no", F.col("_p.heading").alias("heading"), F.col("_p.text").alias("text"))


def postings(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., term, tf): how often each token occurs in each row."""
    return rows.select(*key, F.explode(tokens(F.col(text))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    return rows.select(*key, F.size(tokens(F.col(text))).alias("len"))


def query_terms(questions: DataFrame, key: str, text: str, prefixes: bool = False) -> DataFrame:
    """(key, term, times): exact terms of each question; a repeated word counts as often as it occurs.

    With prefixes, words of five or more characters ask for their stem as well, written "stem*", once.
    """
    words = questions.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("times"))
    if not prefixes:
        return words
    return words.unionByName(query_prefixes(questions, key, text).select(key, F.concat("stem", F.lit("*")).alias("term"), F.lit(1).cast("long").alias("times")))


def query_prefixes(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stem): distinct stems of the words of five or more characters."""
    words = questions.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return words.select(key, prefix_stem(F.col("term")).alias("stem")).where("stem is not null").distinct()


def prefix_matches(terms: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, term): vocabulary words that begin with a stem, by an equal join on the words' own prefixes."""
    stem_list = stems.select("stem").distinct()
    cut = terms.select("term").distinct().where(F.length("term") >= 4).select("term", F.explode(F.transform(F.sequence(F.lit(4), F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("stem"))
    return cut.join(stem_list, "stem")


def unmatched(questions: DataFrame, rows: DataFrame, key: str, question: str, text: str, limit: int = 12) -> DataFrame:
    """(key, rank, term): the words of three or more characters of each question that no row has, the first ones in their order.

    Rows meet the asked words where they are read, so only hits are shuffled.
    """
    asked = questions.select(key, F.posexplode(F.array_distinct(tokens(F.col(question), 3))).alias("_pos", "term"))
    found = term_hits(rows.select(F.lit(0).alias("_all"), text), ["_all"], text, asked).select("term").distinct()
    return ranking.top(asked.join(found, "term", "left_anti"), [key], [F.asc("_pos")], limit).select(key, "rank", "term")


def best_lines(questions: DataFrame, docs: DataFrame, key: str, doc: str, question: str, text: str) -> DataFrame:
    """(key, doc, line, raw, score): for each question (key, doc, question) the line of its document whose stems weigh most, a stem weighing one over the lines with it."""
    lines = docs.join(questions.select(doc).distinct(), doc).select(doc, F.posexplode(F.split(text, "\n")).alias("line", "_t"))
    words = lines.select(doc, "line", F.explode(stems(F.col("_t"))).alias("stem"))
    weight = words.groupBy(doc, "stem").agg((1 / F.count(F.lit(1))).alias("w"))
    asked = questions.select(key, doc, F.explode(stems(F.col(question))).alias("stem"))
    scored = asked.join(words, [doc, "stem"]).join(weight, [doc, "stem"]).groupBy(key, doc, "line").agg(F.sum("w").alias("raw")).withColumn("score", F.round("raw", 8))
    return ranking.top(scored, [key], [F.desc("score"), F.asc("line")], 1).select(key, doc, "line", "raw", "score")


def term_hits(rows: DataFrame, key: list[str], text: str, asked: DataFrame) -> DataFrame:
    """(key..., len, term, tf): how often each row has each asked term (term), and how many tokens in all.

    Tokens meet the asked terms where they are read: those are broadcast after a count, so only hits are shuffled.
    A term "stem*" is hit by every word that begins with the stem.
    """
    terms = asked.select("term").distinct()
    count, most, prefixes = terms.limit(ASKED_TERMS + 1).agg(
        F.count(F.lit(1)), F.max(F.when(F.endswith("term", F.lit("*")), F.length("term") - 1)), F.min(F.when(F.endswith("term", F.lit("*")), F.length("term") - 1)),
    ).first()
    few = count <= ASKED_TERMS
    if not few:
        prefixes, most = 4, 255
    found = rows.select(*key, tokens(F.col(text)).alias("_tokens")).select(*key, F.size("_tokens").alias("len"), F.explode("_tokens").alias("term"))
    if prefixes:
        stem = lambda n: F.concat(F.substring(F.col("term"), F.lit(1), n), F.lit("*"))
        stems = F.when(F.length("term") >= prefixes, F.transform(F.sequence(F.lit(prefixes), F.least(F.length("term"), F.lit(most))), stem)).otherwise(F.array().cast("array<string>"))
        found = found.select(*key, "len", F.explode(F.concat(F.array("term"), stems)).alias("term"))
    return found.join(F.broadcast(terms) if few else terms, "term").groupBy(*key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(rows: DataFrame, key: list[str], text: str, asked: DataFrame, question: str) -> DataFrame:
    """(question, key..., raw, score): BM25 over all rows (key..., text) whose text isn't null; scopes apply afterwards.

    score is rounded to 10 decimals and decides ranks; raw is what it was before. The corpus statistics are one row, and
    document frequencies are computed for asked terms (question, term, times) only.
    """
    full = rows.where(F.col(text).isNotNull())
    stats = full.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg(F.size(tokens(F.col(text)))).alias("avg_len"))
    hits = term_hits(full, key, text, asked)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.join(F.broadcast(stats)).select("term", "avg_len", F.when(raw > 0, raw).otherwise(IDF_FLOOR).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighed = hits.join(asked.join(idf, "term"), "term").select(question, *key, (weight * F.col("times")).alias("w"))
    return weighed.groupBy(question, *key).agg(F.sum("w").alias("raw")).withColumn("score", F.round("raw", 10))
