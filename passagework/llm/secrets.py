"""Secret scans: Boolean trigram queries derived from each rule's regex, a trigram index, and verified spans."""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import once
from passagework.llm.shared import BROADCAST_ROWS, running, settled, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java regular expression, and how long a match (or the group `measured`) must be.

    `whole_runs` says that the regex matches maximal runs of its last class, so that {n,} in place of + finds the
    matches that are long enough and no others; then the length is part of the regex.
    """

    kind: str
    regex: str
    least: int = 0
    measured: int = 0


#: The base kinds, in the order in which equal starts are listed, then those that are added.
ASSIGN = Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2)
ACCESS = Rule("access", r"AKIA[A-Z0-9]{16,}")
HEX = Rule("hex", r"[0-9a-f]{24,}")
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (ASSIGN, ACCESS, HEX, *ADDED)

#: A query is True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple[str, tuple]

_MOST_STRINGS = 64


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    parts = sorted(set(parts), key=repr)
    if kind == "or":  # a part that asks for more than another does adds nothing
        asks = [{p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else {p} for p in parts]
        parts = [p for i, p in enumerate(parts) if not any(asks[j] < asks[i] for j in range(len(parts)))]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text has that holds one of the strings: all trigrams of one of them."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings that the expression can match, if few; else None, and a query that every match satisfies)."""
    strings: set[str] | None = {""}
    found: list[Query] = []

    def close() -> None:
        nonlocal strings
        if strings:
            found.append(_of_strings(strings))
        strings = {""}

    for op, value in tree:
        exact: set[str] | None = None
        query: Query = True
        if op is ops.LITERAL:
            exact = {chr(value).lower()}
        elif op is ops.IN and all(x[0] is ops.LITERAL for x in value) and len(value) <= 8:
            exact = {chr(x[1]).lower() for x in value}
        elif op is ops.SUBPATTERN:
            exact, query = _walk(value[3])
        elif op is ops.BRANCH:
            each = [_walk(x) for x in value[1]]
            exact = set().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
            query = _both("or", [_of_strings(e) if e is not None else q for e, q in each])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, inner = value
            exact, query = _walk(inner)
            if low == 0 and high == 1 and exact is not None:
                exact = exact | {""}
            elif low == high == 1:
                pass
            else:
                exact, query = None, _of_strings(exact) if low and exact is not None else query if low else True
        elif op is ops.AT:
            exact = {""}
        if exact is not None and len(strings) * len(exact) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
        else:
            close()
            found.append(query if exact is None else _of_strings(exact))
    if found:
        close()
        return None, _both("and", found)
    return strings, _of_strings(strings)


def trigram_query(regex: str) -> Query:
    """The condition on a lower-cased text's trigrams that every match of the regex implies; True if there is none."""
    return _walk(parser.parse(regex))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query: Query, held: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_holds(q, held) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def _asked(rules: tuple[Rule, ...]) -> dict[str, Query]:
    """The trigram query of each kind that has one."""
    return {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}


def _wanted(asked: dict[str, Query]) -> list[str]:
    return sorted(set().union(*map(trigrams, asked.values())))


def _held(low: Column, wanted: list[str]) -> Column:
    """Which of the wanted trigrams a lower-cased text holds."""
    return F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in wanted)))


def _kinds(held: Column, asked: dict[str, Query]) -> Column:
    """The kinds whose query the held trigrams satisfy."""
    return F.array_compact(F.array(*(F.when(_holds(q, held), F.lit(kind)) for kind, q in asked.items())))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, doc_id): the index, a row for each of the wanted trigrams and each document that holds it."""
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(_held(F.col("low"), wanted)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): for each document with any, the rules with mandatory trigrams whose query its postings satisfy.

    The lists of all trigrams are intersected by document: a document is in no more lists than the rules have trigrams,
    so no list, however long, meets in one task. Rules without mandatory trigrams ask for no list; where no rule has
    any, there are no candidates.
    """
    asked = _asked(rules)
    if not asked:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id", F.array(F.lit("")).alias("kinds")).schema)
    lists = postings(docs.where(F.col("doc_id").isNotNull()), _wanted(asked)).groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    return lists.select("doc_id", _kinds(F.col("held"), asked).alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches, leftmost and not overlapping, in code points.

    The text between matches and the matches themselves alternate, so running lengths give the places.
    """
    between = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), lambda x: F.length(x))
    size = whole
    if rule.measured:
        size = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.measured)), lambda x: F.length(x))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def span(x: Column) -> Column:
        start = x["at"] + x["gap"]
        return F.struct(start.alias("start"), (start + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"))

    def found(p: Column) -> Column:
        before = running(F.zip_with(p["gap"], p["len"], lambda gap, n: gap + F.coalesce(n, F.lit(0))))
        steps = F.zip_with(before, F.arrays_zip(p["gap"].alias("gap"), p["len"].alias("len"), p["size"].alias("size")), lambda at, x: F.struct(at.alias("at"), x["gap"].alias("gap"), x["len"].alias("len"), x["size"].alias("size")))
        return F.transform(F.filter(steps, lambda x: x["len"].isNotNull() & (x["size"] >= rule.least)), span)

    parts = F.struct(between.alias("gap"), whole.alias("len"), size.alias("size"))
    return F.when(text.rlike(rule.regex), once(parts, found)).otherwise(none)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, spans): every row of docs, all its columns in `row`, with its secrets; see scan().

    Few candidates are broadcast to the texts; where they are many, each text is asked again for its own trigrams, which
    moves no text and finds the same.
    """
    whole = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = _asked(rules)
    found = settled(candidates(whole.select("doc_id", "text"), rules))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = whole.join(F.broadcast(found), "doc_id", "left")
        verified = lambda kind: F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    else:
        both = whole.withColumn("low", F.lower("text")).withColumn("kinds", _kinds(_held(F.col("low"), _wanted(asked)), asked))
        verified = lambda kind: F.array_contains("kinds", kind)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    each = [F.when(verified(r.kind), _spans(F.col("text"), r)).otherwise(none) if r.kind in asked else _spans(F.col("text"), r) for r in rules]
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))

    def before(a: Column, b: Column) -> Column:
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order[a["kind"]] - order[b["kind"]])

    # a filter on the spans stays above inline(); pushed below, it would search every text once more
    spans = both.select("row", F.concat(*each).alias("spans")).select("row", F.when(F.size("spans") < 2, F.col("spans")).otherwise(F.array_sort("spans", before)).alias("spans"))
    return spans.select("row", F.inline(F.array(F.struct("spans"))))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): all secrets of every row of docs (doc_id, text), with DataFrame functions only.

    spans is array<struct<start, end, kind>> by start, then kind as the rules are listed; code points, end
    exclusive. Rules with mandatory trigrams are verified on the candidates of the index only, the others on every
    text. Null text is empty; rows without a doc_id are verified against all rules; repeated rows are scanned each;
    an empty table gives no rows; further columns are ignored.
    """
    return scanned(docs.select("doc_id", "text"), rules).select("row.doc_id", "spans")


def masked(text: Column, spans: Column) -> Column:
    """The text with every secret replaced by its first kind; spans that overlap are one secret."""
    ends = F.transform(spans, lambda x: x["end"])
    # the running ends are computed once for all spans
    shown = F.zip_with(
        spans, running(ends, largest=True),
        lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit("<"), x["kind"], F.lit(">"))).otherwise(""),
    )
    end = F.coalesce(F.array_max(ends), F.lit(0))
    return F.concat(F.array_join(shown, ""), F.substring(text, end + 1, F.length(text)))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with the secrets in `text` masked; n_chars, where there is one, follows the text.

    Null text stays null; rows without a doc_id are searched for all rules; repeated rows are masked each; an empty
    table stays empty.
    """
    found = scanned(docs)
    hit = F.size("spans") > 0
    text = F.when(hit, masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    plain = found.select("row", F.inline(F.array(F.struct(text.alias("masked"), hit.alias("hit")))))
    values = {"text": F.col("masked"), "n_chars": F.when(F.col("hit"), F.length("masked")).otherwise(F.col("row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return plain.select(*(values[c].alias(c) if values.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _equals(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in (ASSIGN, ACCESS, HEX)]
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.array_size(F.filter(F.col("spans.kind"), _equals(k))).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule) -> str:
    regex = rule.regex.replace("'", "''")
    size = f"regexp_extract_all(t, '{regex}', {rule.measured})"
    return f"""list_filter(list_transform(generate_series(1, len(regexp_extract_all(t, '{regex}'))), lambda i: {{
        's': list_sum(list_transform(string_split_regex(t, '{regex}')[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(regexp_extract_all(t, '{regex}')[1:i - 1], lambda x: length(x))), 0),
        'n': length(regexp_extract_all(t, '{regex}')[i]), 'm': length({size}[i])}}), lambda x: x.m >= {rule.least})"""


_SQL_KINDS = ", ".join(f"{_sql_spans(r)} as k{i}" for i, r in enumerate(RULES))
_SQL_ALL = " union all ".join(f"select r, {i} as k, '{r.kind}' as kind, unnest(k{i}) as x from found" for i, r in enumerate(RULES))
OP6_SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as (select r, {_SQL_KINDS} from docs),
spans as (select r, k, kind, x.s::bigint as s, kind || ':' || x.s::bigint || ':' || (x.s + x.n)::bigint as span from ({_SQL_ALL})),
listed as (
  select r, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c,
         string_agg(span, ',' order by s, k) as spans, string_agg(span, ',' order by s, k) filter (k < 3) as base
  from spans group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join listed using (r)
"""
