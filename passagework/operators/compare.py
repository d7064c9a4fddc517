"""New items against what is recorded, what may be shared, and the settings of several teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import mask_kinds, masked, squeezed
from passagework.operators import ranking

# Words that make a text a question, and what a client's own lines begin with.
QUESTION_WORDS = (
    "ne", "neden", "niye", "nasıl", "kim", "kime", "hangi", "kaç", "nerede", "nereye", "mı", "mi", "mu", "mü", "mısın", "misin",
    "what", "why", "how", "who", "which", "when", "where", "does", "do", "did", "is", "are", "can", "should",
)
HARNESS = ("<task-notification", "<agent-message", "<command-name>", "<command-message>", "[SYSTEM NOTIFICATION", "<recommended_plugins>", "# AGENTS.md", "<user_instructions>", "<permissions instructions>")
SETTLED, NOT_SHARED, PRIVATE = ("accepted", "fixed"), ("open item", "açık iş"), ("secret", "private")


def is_question(text: Column) -> Column:
    """Whether a search is a question, by its end or its words, rather than a topic."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.endswith(low, F.lit("?")) | F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS)))


def is_harness(text: Column) -> Column:
    """Lines of a transcript that a client wrote, and empty ones."""
    own = F.coalesce(text, F.lit("")) == ""
    for start in HARNESS:
        own |= F.startswith(F.coalesce(text, F.lit("")), F.lit(start))
    return own | F.contains(F.substring(F.coalesce(text, F.lit("")), 1, 200), F.lit("<environment_context>"))


def comparable(evidence: DataFrame, by: str, most: int = 6) -> DataFrame:
    """The first passages (by, place, path, sensitivity, ...) that an item may be compared with: no raw chats, recaps, meetings or secret notes."""
    hidden = F.lower(F.coalesce("sensitivity", F.lit(""))) == "secret"
    for part in ("chat-raw", "/harvest/", "/session/", "/meet/"):
        hidden |= F.contains("path", F.lit(part))
    return ranking.top(evidence.where(~hidden), [by], [F.asc("place")], most, "n")


def judge_view(path: Column, date: Column, kind: Column, text: Column) -> Column:
    """What a judge sees of a passage: its facts and its text, secrets masked."""
    return F.struct(path.alias("source"), date.alias("date"), kind.alias("type"), masked(text).alias("text"))


def note_side(text: Column, limit: int = 600) -> Column:
    """The passage that contradicts an item, as the item keeps it."""
    return F.substring(squeezed(masked(text)), 1, limit)


def merged_verdicts(items: DataFrame, evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """items (item_id, ...) with verdict, match and match_text, from a comparer's answers (item_id, pos, verdict, passage); unusable answers leave an item new.

    evidence has item_id, n, path and text; an answer names its passage as p and n. Of several usable answers the last holds.
    """
    n = F.expr("try_cast(regexp_extract(passage, '^p([0-9]+)$', 1) as int)")
    asked = answers.where(F.col("verdict").isin("known", "conflict")).withColumn("n", n).join(evidence.select("item_id", "n", "path", "text"), ["item_id", "n"])
    last = asked.groupBy("item_id").agg(F.max_by(F.struct("verdict", "path", "text"), "pos").alias("a"))
    told = F.when(F.col("a.verdict") == "conflict", note_side(F.col("a.text")))
    return items.join(last, "item_id", "left").withColumns({"verdict": F.coalesce("a.verdict", F.lit("new")), "match": F.col("a.path"), "match_text": told}).drop("a")


def share_checks(items: DataFrame) -> DataFrame:
    """items (kind, decision, statement, quote, sensitivity, author) with refused, the first reason against sharing, and blocked, the kinds of secrets in the text."""
    reason = (
        F.when(F.trim(F.coalesce("author", F.lit(""))) == "", "needs_author").when(~F.coalesce(F.col("decision").isin(*SETTLED), F.lit(False)), "needs_approved_item")
        .when(F.lower("kind").isin(*NOT_SHARED), "not_for_open_items").when(F.lower(F.coalesce("sensitivity", F.lit(""))).isin(*PRIVATE), "linked_note_private")
    )
    return items.withColumns({"refused": reason, "blocked": F.array_sort(mask_kinds(F.concat_ws("\n", "statement", "quote")))})


def sign_in(settings: DataFrame) -> DataFrame:
    """One row from team settings (place, domains, key): all mail domains, each once in the order of the teams, and the first key."""
    domains = settings.select("place", F.posexplode("domains").alias("pos", "domain")).withColumn("domain", F.lower(F.trim("domain"))).groupBy("domain").agg(F.min(F.struct("place", "pos")).alias("at"))
    listed = domains.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "domain"))), lambda d: d["domain"]).alias("domains"))
    return listed.join(F.broadcast(settings.agg(F.min_by("key", F.when(F.coalesce("key", F.lit("")) != "", F.col("place"))).alias("key"))))


def settings_conflict(settings: DataFrame) -> DataFrame:
    """One row from team settings (retrieval, version as an array of numbers): whether they differ in retrieval, and the largest version asked for."""
    return settings.agg((F.count_distinct("retrieval") > 1).alias("conflict"), F.max("version").alias("version"))


def pack_report(packs: DataFrame, fingerprint: str) -> DataFrame:
    """(source_id, state) of shipped packs (source_id, fingerprint): usable with this embedding, or incompatible."""
    return packs.groupBy("source_id").agg(F.when(F.min(F.coalesce(F.col("fingerprint") == fingerprint, F.lit(False))), "usable").otherwise("incompatible").alias("state"))


def clone_flags(states: DataFrame) -> DataFrame:
    """(place, flag): what is wrong with team clones (place, kind, reason, status, behind), each flag once, by its first source."""
    reason = F.when(F.col("reason") == "local_changes", "has_local_changes").when(F.col("reason") == "unpushed_commits", "has_unpushed_commits").when(F.col("status") == "failed", "sync_failed")
    rows = states.where("kind = 'team_clone'").select("place", F.posexplode(F.array_compact(F.array(reason, F.when(F.col("behind"), "behind")))).alias("pos", "flag"))
    first = rows.groupBy("flag").agg(F.min(F.struct("place", "pos")).alias("at"))
    return first.select(F.col("at.place").alias("place"), F.col("at.pos").alias("pos"), "flag")


def unknown_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The asked ids that nobody knows, each once."""
    return asked.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def first_of_each(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place): distinct values with the place where each comes first."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias(place))


def reply_items(replies: DataFrame, key: str, text: str, field: str = "items") -> DataFrame:
    """(key, pos, item): the objects of a model's reply, as JSON text: the list `field` of what stands between the outermost braces; other replies give none."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    listed = F.from_json(F.get_json_object(inner, f"$.{field}"), "array<string>")
    rows = replies.select(key, F.posexplode(listed).alias("pos", "item"))
    return rows.where(F.startswith("item", F.lit("{")))


def state_counts(evidence: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """(by, returned_chars, candidates): how much a search returned, and from how many candidates."""
    n = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"))
    return evidence.groupBy(by).agg(F.sum(F.length("shown")).alias("returned_chars")).join(n, by, "full").select(by, F.coalesce("returned_chars", F.lit(0)).alias("returned_chars"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
