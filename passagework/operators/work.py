"""Work lists: cards of boards, open items and notes that wait for a person, and what was decided lately."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import once, owners, person, same_person
from passagework.operators import ranking

# The words that name a list of finished cards, and those before them that say the opposite.
DONE_WORDS = ("done", "completed", "finished", "tamamlandi", "tamamlanan", "tamamlananlar", "bitti", "biten", "bitenler")
NOT_DONE = ("not", "be", "yet")
OPEN_KINDS, DECISION_KINDS = ("open item", "açık iş"), ("decision", "karar")
SETTLED = ("accepted", "fixed")


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, "İIıŞşĞğÜüÖöÇç", "iiissgguuoocc"))


def is_done_list(name: Column) -> Column:
    """Whether a list holds finished cards: a whole word says so, and the word before it doesn't say the opposite."""
    words = F.regexp_extract_all(_folded(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    said = lambda ws: F.exists(F.transform(ws, lambda w, i: w.isin(*DONE_WORDS) & ((i == 0) | ~F.coalesce(F.get(ws, i - 1), F.lit("")).isin(*NOT_DONE))), lambda x: x)
    return once(words, said)


def handed_to(title: Column, phrases: list[str], name: Column) -> Column:
    """Whether a title has one of the phrases, {name} being the person's first name, as whole words side by side."""
    spaced = lambda text: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(person(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " "), F.lit(" "))
    first = F.element_at(F.split(person(name), " "), 1)
    found = F.lit(False)
    for p in phrases:
        wanted = spaced(F.replace(F.lit(p), F.lit("{name}"), first))
        found |= (first != "") & (F.trim(wanted) != "") & F.contains(spaced(title), wanted)
    return found


def owned_by(value: Column, name: Column) -> Column:
    """Whether one of the owners that a value names is the person."""
    return F.exists(owners(value), lambda o: same_person(o, name))


def open_cards(cards: DataFrame, lists: DataFrame, boards: DataFrame) -> DataFrame:
    """cards (list_id, due_complete, ...) on the open lists of open boards, with list and board names; finished ones are left out.

    lists has list_id, board_id and list_name, boards has board_id and board.
    """
    places = lists.where(~is_done_list(F.col("list_name"))).join(boards, "board_id")
    return cards.where(~F.coalesce("due_complete", F.lit(False))).join(places, "list_id").drop("due_complete")


def shown_cards(cards: DataFrame, hidden: list[str], since: str | None = None) -> DataFrame:
    """Cards of the boards that aren't hidden, from a day on; a card's day is its due date, or its latest activity."""
    rows = cards if not since else cards.where(F.substring(F.coalesce(F.nullif("due", F.lit("")), F.nullif("touched", F.lit("")), F.lit("")), 1, 10) >= since)
    return rows.where(~F.col("board_id").isin(*hidden)) if hidden else rows


def board_counts(boards: DataFrame, cards: DataFrame, since: str | None = None) -> DataFrame:
    """(board_id, board, cards, place): boards with the number of their cards, zeros included, most first."""
    n = shown_cards(cards, [], since).groupBy("board_id").agg(F.count(F.lit(1)).alias("n"))
    rows = boards.join(n, "board_id", "left").select("board_id", "board", F.coalesce("n", F.lit(0)).cast("long").alias("cards"))
    return ranking.numbered(rows, [], [F.desc("cards"), F.lower("board").asc(), F.asc("board_id")], "place")


def by_urgency(rows: DataFrame, by: list[str], key: list[str], place: str = "place") -> DataFrame:
    """rows (due, touched, ...) numbered in each group: dated work first, the nearest at the top, then the latest activity."""
    order = [F.asc_nulls_last(F.nullif("due", F.lit(""))), F.desc_nulls_last("touched"), *(F.asc(k) for k in key)]
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def waiting_notes(notes: DataFrame, name: str, inbox: str, phrases: list[str], statuses: list[str]) -> DataFrame:
    """Notes (path, title, owner, status, touched) that are a person's, with state: handed or review for what waits for them, owned for the rest."""
    mine = F.coalesce(owned_by(F.col("owner"), F.lit(name)), F.lit(False))
    handed = F.startswith("path", F.lit(inbox)) & handed_to(F.col("title"), phrases, F.lit(name))
    state = F.when(handed, "handed").when(F.lower(F.coalesce("status", F.lit(""))).isin(*statuses), "review").otherwise("owned")
    return notes.where(mine | handed).withColumn("state", state)


def recent_items(items: DataFrame, done: DataFrame, kinds: tuple[str, ...], since: str | None = None, most: int | None = None) -> DataFrame:
    """Settled items (path, id, kind, statement, decision, day) of some kinds, each statement once from the newest recap, newest first.

    Items marked done (path, id) are left out; since and most limit what is left.
    """
    first = F.row_number().over(Window.partitionBy(F.lower("statement")).orderBy(F.desc("path"), F.asc("id")))
    own = items.where(F.col("decision").isin(*SETTLED)).withColumn("_first", first).where("_first = 1").drop("_first")
    own = own.where(F.lower("kind").isin(*kinds)).join(done.select("path", "id"), ["path", "id"], "left_anti")
    own = own if since is None else own.where(F.col("day") >= since)
    ordered = own.orderBy(F.desc("day"), F.asc("path"), F.asc("id"))
    return ordered if most is None else ordered.limit(most)


def marked_done(done: DataFrame, targets: DataFrame, day: str) -> DataFrame:
    """done (path, id, at) with the targets (path, id) that it lacks, each once."""
    fresh = targets.where(F.col("path").isNotNull() & F.col("id").isNotNull()).select("path", "id").distinct().join(done.select("path", "id"), ["path", "id"], "left_anti")
    return done.unionByName(fresh.withColumn("at", F.lit(day)))


def recaps_of_window(paths: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Recaps (path) in the inbox whose names begin with a day of the last `days`, with that day and their place, newest first."""
    name = F.substring_index("path", "/", -1)
    day = F.when(name.rlike(r"^\d{4}-\d{2}-\d{2} — (?:session|harvest) .*\.md$"), F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd"))
    rows = paths.where(F.startswith("path", F.lit("+/"))).withColumn("day", day).where(F.datediff(F.lit(today).cast("date"), F.col("day")) <= days)
    return ranking.numbered(rows, [], [F.desc(F.substring_index("path", "/", -1)), F.asc("path")], "place")


def waiting_counts(items: DataFrame) -> DataFrame:
    """(path, waiting, repeated): undecided items of each recap, and how many ids it holds more than once."""
    ids = items.groupBy("path", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision").isNull() | (F.col("decision") == "open")).alias("open"))
    return ids.groupBy("path").agg(F.sum("open").alias("waiting"), F.count_if(F.col("n") > 1).alias("repeated"))


def state_pack(opens: DataFrame, decisions: DataFrame, most_open: int = 12, most_decisions: int = 8) -> DataFrame:
    """(part, place, line): the lines of a hand-over, open items and then decisions, newest first.

    Both have day, statement and id.
    """
    def part(rows: DataFrame, name: str, most: int) -> DataFrame:
        best = ranking.top(rows.withColumn("part", F.lit(name)), ["part"], [F.desc("day"), F.asc("id")], most, "place")
        return best.select("part", "place", F.concat(F.lit("- "), F.col("day"), F.lit(": "), F.col("statement")).alias("line"))

    return part(opens, "open", most_open).unionByName(part(decisions, "decisions", most_decisions))
