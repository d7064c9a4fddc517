"""Chat formatting: conversations rebuilt from event logs, rendered with a loss mask, and read back. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.shared import running, table

#: The template's control strings. A turn is BEGIN, ROLE_OPEN role ROLE_CLOSE, its text (between LOSS_OPEN and
#: LOSS_CLOSE if it is trained on), END. None of them can occur in an escaped role or text.
BEGIN, END = "<s>", "</s>"
ROLE_OPEN, ROLE_CLOSE = "[INST]", "[/INST]"
LOSS_OPEN, LOSS_CLOSE = "<loss>", "</loss>"
_CONTROL = r"([<\[])(/?(?:s>|loss>|INST\]))"
#: Turns that are rendered into one piece before the pieces of a conversation are joined.
BLOCK_TURNS = 256
#: Events that replace what a message said before.
RESTARTS = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    """The text with every backslash doubled and a backslash inside each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rebuilt(events: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text): the final messages of event logs, a row a message.

    `events` has conv_id, turn, place (of a message among those of one turn), seq (of any type that can be ordered,
    rising through a conversation), kind, role and text. The log of a conversation is dealt out by its messages, so a
    hot conversation is many groups. A message's events are applied by seq: "message", "edit"
    and "regenerate" replace its text, "delta" adds to it, "retract" removes the message until one of the former
    follows; the role is that of the last event that names one. Events of equal seq are ordered by kind, role and
    text, so repeated rows count each. Null text is empty; other kinds are ignored; messages without a turn come first.
    """
    known = events.where(F.col("kind").isin(*RESTARTS, "delta", "retract"))
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    logs = known.groupBy("conv_id", "turn", "place").agg(F.array_sort(F.collect_list(event)).alias("log"))

    def applied(state: Column, e: Column) -> Column:
        restart, retract = e["kind"].isin(*RESTARTS), e["kind"] == "retract"
        n = state["n"] + 1
        return F.struct(
            n.alias("n"), F.when(restart, n).when(retract, n + 1).otherwise(state["begin"]).alias("begin"),
            F.when(restart, True).when(retract, False).otherwise(state["live"]).alias("live"), F.coalesce(e["role"], state["role"]).alias("role"),
        )

    # the state says where the text begins in the log, so that no step copies what was said before
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("begin"), F.lit(False).alias("live"), F.lit(None).cast("string").alias("role"))
    folded = logs.select("conv_id", "turn", "place", "log", F.aggregate("log", start, applied).alias("m")).where("m.live or m.begin <= m.n")
    said = F.slice(F.col("log.text"), F.col("m.begin"), F.col("m.n") - F.col("m.begin") + 1)
    return folded.select("conv_id", "turn", "place", F.coalesce("m.role", F.lit("")).alias("role"), F.array_join(said, "").alias("text"))


def rendered(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the messages of each conversation by turn, and the code points under the loss mask.

    Turns are joined in blocks first, so a long conversation's rows are spread over tasks; its text is one value in
    the end. Messages of equal turn are ordered by place.
    """
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(BEGIN + ROLE_OPEN), escaped(F.coalesce("role", F.lit(""))), F.lit(ROLE_CLOSE))
    loss = F.coalesce(F.col("role") == trained, F.lit(False))
    piece = F.concat(head, F.when(loss, F.concat(F.lit(LOSS_OPEN), body, F.lit(LOSS_CLOSE))).otherwise(body), F.lit(END))
    turns = messages.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1)).alias("block"),
        F.struct("turn", "place", piece.alias("piece")).alias("t"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.array_join(F.array_sort(F.collect_list("t"))["piece"], "").alias("text"))
    whole = blocks.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "").alias("formatted"))
    # text and gaps alternate where the mask's marks are; running lengths give its places
    parts = F.split("formatted", f"{LOSS_OPEN}|{LOSS_CLOSE}", -1)
    sizes = F.transform(parts, lambda x: F.length(x))

    widths = F.transform(sizes, lambda n, i: n + F.when(i % 2 == 0, len(LOSS_OPEN)).otherwise(len(LOSS_CLOSE)))
    spans = F.zip_with(sizes, running(widths), lambda n, at: F.struct(at.alias("start"), (at + n).alias("end")))
    return whole.select("conv_id", "formatted", F.filter(spans, lambda _, i: i % 2 == 1).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_texts): the turns as role and text, and the texts under the mask, unescaped.

    Both come from the formatted string alone: its END marks separate turns, its loss marks the masked texts.
    """
    pieces = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(
        unescaped(F.substring_index(F.substring_index(x, ROLE_CLOSE, 1), BEGIN + ROLE_OPEN, -1)).alias("role"),
        unescaped(F.regexp_replace(F.substring_index(x, ROLE_CLOSE, -1), f"^{LOSS_OPEN}|{LOSS_CLOSE}$", "")).alias("text"),
    ))
    masked = F.transform(F.filter(pieces, lambda x: F.endswith(x, F.lit(LOSS_CLOSE))), lambda x: unescaped(F.substring_index(F.substring_index(x, LOSS_OPEN, -1), LOSS_CLOSE, 1)))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), masked.alias("loss_texts"))


def as_events(turns: DataFrame) -> DataFrame:
    """A table of final turns (conv_id, turn, role, text) as the log of how they came about.

    A user's turn is a message with a slip, an edit that empties it, and a delta for each line. An assistant's is an
    empty message, a draft's delta, a regeneration, and a delta for each line; other roles lack the middle part. `seq`
    is (turn, place, step), so one sequence runs through a conversation. Rows that share a turn are messages of their
    own: the key of a message is its place among the rows of that turn, by role and text.
    """
    kept = F.array_sort(F.collect_list(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    each = turns.groupBy("conv_id", "turn").agg(kept.alias("rows")).select("conv_id", "turn", F.posexplode("rows").alias("place", "row"))
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))
    role, lines = F.col("row.role"), F.split("row.text", r"(?<=\n)")
    opening = (
        F.when(role == "user", F.array(event("message", F.substring("row.text", 1, 5), role), event("edit", F.lit(""))))
        .when(role == "assistant", F.array(event("message", F.lit(""), role), event("delta", F.substring("row.text", 1, 5)), event("regenerate", F.lit(None).cast("string"))))
        .otherwise(F.array(event("message", F.lit(""), role)))
    )
    log = each.select("conv_id", "turn", "place", F.posexplode(F.concat(opening, F.transform(lines, lambda x: event("delta", x)))).alias("step", "e"))
    return log.select("conv_id", "turn", "place", F.struct("turn", "place", "step").alias("seq"), "e.kind", "e.role", "e.text")


def format_chats(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """Rebuild, render and mask every conversation of an event log; see rebuilt() and rendered() for the rules.

    A null conv_id is a conversation of its own; an empty log gives no rows; further columns are ignored.
    """
    return rendered(rebuilt(events), trained)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    back = read_back(format_chats(as_events(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
  select *, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|loss>|INST\]))', '\1\\\2', 'g') as safe_role,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|loss>|INST\]))', '\1\\\2', 'g') as safe_text
  from rows
), shown as (
  select *, '<s>[INST]' || safe_role || '[/INST]'
    || case when role = 'assistant' then '<loss>' || safe_text || '</loss>' else safe_text end || '</s>' as piece
  from escaped
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(piece))::bigint as formatted_chars
from shown group by conv_id
"""
