"""Queries on work lists, meetings and written notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import item_id
from passagework.operators import meetings, threads, work, writers
from passagework.plans.recall import inside_first, without_raw_of_written_days
from passagework.sources.tables import table


def cards_join_lists(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cards, customers as lists, nations outside region 0 as open boards: open cards of open lists."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").where("n_regionkey > 0")
    k = F.col("c_custkey") % 4
    lists = c.select(F.col("c_custkey").alias("list_id"), F.col("c_nationkey").alias("board_id"), F.when(k == 0, "Done").when(k == 1, "Not done").when(k == 2, "Tamamlananlar").otherwise("To do").alias("list_name"))
    cards = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("list_id"), (F.col("o_orderstatus") == "F").alias("due_complete"))
    return work.open_cards(cards, lists, n.select(F.col("n_nationkey").alias("board_id"), F.col("n_name").alias("board"))).select("o_orderkey", "list_id", "list_name", "board")


def boards_left_count(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the number of their customers who are dated from a day on, zeros included, most first."""
    c = table(spark, d, "customer")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string")
    cards = c.select(F.col("c_nationkey").alias("board_id"), F.when(F.col("c_custkey") % 2 == 0, day).alias("due"), day.alias("touched"))
    boards = table(spark, d, "nation").select(F.col("n_nationkey").alias("board_id"), F.col("n_name").alias("board"))
    return work.board_counts(boards, cards, "2025-10-01").select("board", "cards", "place")


def work_merge_badges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cards, the flags of their line items as badges: numbered by urgency for each customer."""
    o = table(spark, d, "orders")
    notes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("badges"), F.max("l_shipdate").cast("date").cast("string").alias("touched"))
    rows = o.join(notes, o.o_orderkey == notes.l_orderkey, "left").select("o_custkey", "o_orderkey", F.coalesce("badges", F.lit("")).alias("badges"), "touched", F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("date").cast("string")).alias("due"))
    return work.by_urgency(rows, ["o_custkey"], ["o_orderkey"])


def waiting_notes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a team's notes: handed over by a phrase in the inbox, up for review, or only owned."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("For Can: "), F.col("p_name"))).when(k % 4 == 1, F.concat(F.lit("for Ercan "), F.col("p_name"))).otherwise(F.col("p_name"))
    owner = F.when(k % 3 == 0, "Ann, can kaya").when(k % 3 == 1, "tbd").otherwise("Bob")
    notes = p.select("p_partkey", F.concat(F.when(k % 2 == 0, "in/").otherwise("out/"), k.cast("string")).alias("path"), title.alias("title"), owner.alias("owner"), F.when(k % 5 == 0, "Review").otherwise("stable").alias("status"))
    return work.waiting_notes(notes, "Can Kaya", "in/", ["for {name}"], ["review"]).select("p_partkey", "state")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as items of one recap a source: statements repeat, some are decided."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    i = F.col("doc_id")
    statement = F.concat(F.when(i % 2 == 0, "Use ").otherwise("use "), (i % 90).cast("string"))
    return both.select(
        F.concat(F.lit("+/2025-01-"), F.lpad((F.length("source") + i % 20).cast("string"), 2, "0"), F.lit(" — session x.md")).alias("path"), F.concat(item_id(statement), i.cast("string")).alias("id"), F.when(i % 3 == 0, "Open item").otherwise("decision").alias("kind"),
        statement.alias("statement"), F.when(F.col("quality") == 1, "accepted").alias("decision"), F.concat(F.lit("2025-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("day"),
    )


def recent_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Accepted decisions of the last days, each statement once from the newest recap, without those that are done."""
    items = _items(spark, d)
    done = items.where("length(id) % 2 = 0").select("path", "id")
    return work.recent_items(items, done, work.DECISION_KINDS, since="2025-01-10").select("path", "id", "day", F.lower("statement").alias("statement"))


def state_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a hand-over: twelve open items and eight decisions, newest first."""
    items = _items(spark, d)
    none = items.limit(0).select("path", "id")
    return work.state_pack(work.recent_items(items, none, work.OPEN_KINDS), work.recent_items(items, none, work.DECISION_KINDS))


def waiting_counts(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return work.waiting_counts(items.unionByName(items.where("day > '2025-01-20'")))


def marked_done(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select("path", "id")
    return work.marked_done(items.where("length(id) % 2 = 0").withColumn("at", F.lit("2024-12-31")), items.unionByName(items), "2025-06-01")


def recap_window(spark: SparkSession, d: str) -> DataFrame:
    """Orders as recaps in the inbox, some of other names: those of the last 14 days."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    folder, kind = F.when(k % 5 == 0, "old/").otherwise("+/"), F.when(k % 3 == 0, " — session ").when(k % 3 == 1, " — harvest ").otherwise(" — note ")
    paths = o.select(F.concat(folder, F.date_format("o_orderdate", "yyyy-MM-dd"), kind, k.cast("string"), F.lit(".md")).alias("path"))
    return work.recaps_of_window(paths, "1998-07-01").select("path", F.col("day").cast("string").alias("day"), "place")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("text is not null").select("conv_id", F.col("turn").alias("n"), F.col("role").alias("speaker"), F.col("turn").cast("string").alias("at"), "text")


def located_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Four words from the middle of every turn, cited one turn off: the line that says them."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w")).where("size(w) >= 12")
    items = said.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.array_join(F.slice("w", 5, 4), ", ").alias("quote"), (F.col("turn") + F.col("turn") % 2).alias("cited"))
    return meetings.located(items, _lines(spark, d), "conv_id").select("item_id", "line", "speaker", "said")


def chosen_sides(spark: SparkSession, d: str) -> DataFrame:
    """Turns as heard twice; the new recogniser missed most of the assistant in every second conversation."""
    earlier = _lines(spark, d).select("conv_id", "speaker", "n", "text")
    fresh = earlier.where("not (conv_id % 2 = 0 and speaker = 'assistant' and n % 8 <> 1)")
    return meetings.chosen_sides(fresh, earlier, "conv_id").select("conv_id", "speaker", "n", "earlier")


def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", meetings.longest_run(F.col("text")).alias("run"))


def made_up_lines(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(k == 0, "Thanks for watching!").when(k == 1, F.concat(F.col("text"), F.lit(" thank you for watching"))).when(k == 2, "ALTYAZI M.K.").otherwise(F.col("text"))
    return _lines(spark, d).select("conv_id", F.col("n").alias("turn"), "text").select("conv_id", "turn", meetings.made_up(text).alias("made_up"))


def loop_windows(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as loops, other events as segments of their user, in minutes: what overlaps a padded loop."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000 - 28_000_000).alias("start"))
    rows = e.withColumn("end", F.col("start") + F.col("event_id") % 40)
    loops = rows.where("event_type = 'purchase'").withColumnRenamed("event_id", "loop_id")
    return meetings.loop_windows(loops, rows.where("event_type <> 'purchase'").withColumnRenamed("event_id", "segment_id"), "user_id").select("loop_id", "segment_id")


def first_points(spark: SparkSession, d: str) -> DataFrame:
    """Turns as points, every fourth one as the start of a part: the first points of each part."""
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line")).distinct()
    return meetings.first_points(t, t.where("line % 4 = 0").withColumnRenamed("line", "start"), "conv_id")


def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", (F.col("turn") * 700).alias("start"), F.col("role").alias("speaker"), "text")
    return meetings.transcript_lines(rows, "conv_id", {"user": "Me", "assistant": "Others"}).select("conv_id", "n", F.md5("text").alias("text_md5"))


def raw_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges that raw transcripts gain; those of every third conversation hold their first two already."""
    x = threads.exchanges(table(spark, d, "conversations"))
    held = writers.held_exchanges(writers.raw_transcripts(x.where("conv_id % 3 = 0 and i <= 2"), x.limit(0).select("conv_id", F.col("i").alias("last")), "conv_id"), "conv_id", "text")
    return writers.raw_transcripts(x, held, "conv_id").select("conv_id", "fresh", F.md5("text").alias("text_md5"))


def recap_texts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as items of recaps, one a source, in four groups."""
    both, i = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), F.col("doc_id")
    items = both.select(
        "source", i.alias("item_id"), F.when(F.col("quality") == 0, "dropped").when(F.col("toxic") == 1, "conflict").when(i % 3 == 0, "known").otherwise("new").alias("grp"), F.when(i % 2 == 0, "decision").otherwise("fact").alias("type"),
        F.concat(F.lit("document "), i.cast("string")).alias("statement"), F.col("lang").alias("quote"), (i % 9).alias("exchange"), F.lit("owner").alias("speaker"), F.when(i % 4 == 0, "2025-01-01").alias("at"),
        F.concat(F.lit("note"), (i % 5).cast("string")).alias("match"), F.when(F.col("toxic") == 1, "other").alias("match_text"), F.lit("").alias("why"), F.when(i % 6 == 0, "assistant").alias("attribution"),
    )
    return writers.recaps(items, "source", F.concat(F.lit("Recap "), F.col("source")), F.lit("2025-01-02")).select("source", F.md5("text").alias("text_md5"))


def day_logs(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders as entries of their day's log; every second year has logs, some of which end in another heading."""
    o = table(spark, d, "orders")
    day, y = F.date_format("o_orderdate", "yyyy-MM-dd"), F.year("o_orderdate")
    entries = o.where("o_orderpriority = '1-URGENT'").select(writers.log_day(F.lit(""), day, F.lit("2025-01-01")).alias("day"), F.col("o_orderkey").alias("id"), writers.log_line(F.lit("decision"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.lit(""), F.col("o_orderkey") % 2 == 0).alias("line"))
    held = o.where(y % 2 == 0).select(day.alias("day"), F.when(F.dayofmonth("o_orderdate") % 2 == 0, F.concat(F.lit("# "), day, F.lit("\n\n## Chats\n\n- old\n"))).otherwise("# x\n\n## Other\n\n- old\n\n").alias("text")).distinct()
    return writers.logs(entries, held, "Chats").select("day", F.md5("text").alias("text_md5"))


def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    """Parts as notes of equal titles: each gets a path of its own beside those that are taken."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(' A: "'), F.substring_index("p_name", " ", 1), F.lit('"? ')).alias("t"))
    taken = p.where("id % 10 = 0").select(F.concat(F.lit("notes/A "), F.regexp_extract("t", r'"([^"]*)"', 1), F.when(F.col("id") % 20 == 0, F.concat(F.lit(" ("), F.col("id").cast("string"), F.lit(")"))).otherwise(""), F.lit(".md")).alias("path")).distinct()
    return writers.unique_paths(p, "notes", F.col("t"), taken).select("id", "path")


def raw_hidden_by_written_day(spark: SparkSession, d: str) -> DataFrame:
    """Events as notes of their user's hours: raw ones (views, clicks) count only in hours without a written one (a purchase)."""
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    rows = e.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("day"), F.when(F.col("event_type") == "purchase", "note").otherwise("clip").alias("kind"), F.lit("").alias("path"))
    return without_raw_of_written_days(rows, "day", ("user_id",)).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def inside_then_outside(spark: SparkSession, d: str) -> DataFrame:
    """Of each priority the ten dearest orders of 1996, then the ten dearest of all that aren't among them."""
    from passagework.operators.ranking import top

    o = table(spark, d, "orders")
    best = lambda rows: top(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
    return inside_first(best(o.where(F.year("o_orderdate") == 1996)), best(o), ["o_orderpriority"], ["o_orderkey"])


QUERIES = {f.__name__: f for f in (
    cards_join_lists, boards_left_count, work_merge_badges, waiting_notes, recent_decisions, state_lines, waiting_counts, marked_done, recap_window, located_quotes, chosen_sides, longest_runs, made_up_lines, loop_windows,
    first_points, transcript_lines, raw_transcripts, recap_texts, day_logs, unique_paths, raw_hidden_by_written_day, inside_then_outside,
)}
_ITEMS = """i as (select doc_id, '+/2025-01-' || lpad((length(source) + doc_id % 20)::varchar, 2, '0') || ' — session x.md' as path, substr(sha1('use ' || doc_id % 90), 1, 10) || doc_id as id,
  case when doc_id % 3 = 0 then 'open item' else 'decision' end as kind, case when doc_id % 2 = 0 then 'Use ' else 'use ' end || doc_id % 90 as statement, quality = 1 as ok, '2025-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as day from documents join labels using (doc_id)),
f as (select *, row_number() over (partition by lower(statement) order by path desc, id) as r from i where ok)"""
_LINES = r"l as (select conv_id, turn, role, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') as t, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from conversations where text is not null)"
_X = """n as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn, role rows unbounded preceding)::bigint as i from conversations),
x as (select conv_id, i, coalesce(arg_max(text, turn) filter (role = 'user'), '') as u, coalesce(arg_max(text, turn) filter (role = 'assistant'), '') as a from n where i > 0 group by all)"""
_RUN = "coalesce((list_max(list_transform(regexp_extract_all(array_to_string(list_transform(range(1, len(w) - {n} + 1), lambda i: case when w[i] = w[i + {n}] then '1' else '0' end), ''), '1+'), lambda x: length(x))) // {n})::int, 0) + 1"
SQL = {
    "cards_join_lists": """select o_orderkey, c_custkey as list_id, case c_custkey % 4 when 1 then 'Not done' else 'To do' end as list_name, n_name as board
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey > 0 and o_orderstatus <> 'F' and c_custkey % 4 in (1, 3)""",
    "boards_left_count": """with c as (select n_name as board, count(c_custkey) filter (date '2025-01-01' + (c_custkey % 300)::int >= date '2025-10-01') as cards, n_nationkey from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name)
select board, cards, row_number() over (order by cards desc, lower(board), n_nationkey) as place from c""",
    "work_merge_badges": """with n as (select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as badges, max(l_shipdate)::date::varchar as touched from lineitem group by 1),
r as (select o_custkey, o_orderkey, coalesce(badges, '') as badges, touched, case when o_orderstatus = 'O' then o_orderdate::date::varchar end as due from orders left join n on l_orderkey = o_orderkey)
select *, row_number() over (partition by o_custkey order by due nulls last, touched desc nulls last, o_orderkey) as place from r""",
    "waiting_notes": """select p_partkey, case when p_partkey % 4 = 0 then 'handed' when p_partkey % 5 = 0 then 'review' else 'owned' end as state from part where p_partkey % 4 = 0 or p_partkey % 3 = 0""",
    "recent_decisions": f"with {_ITEMS} select path, id, day, lower(statement) as statement from f where r = 1 and kind = 'decision' and day >= '2025-01-10' and length(id) % 2 = 1",
    "state_lines": f"""with {_ITEMS}, p as (select case kind when 'decision' then 'decisions' else 'open' end as part, row_number() over (partition by kind order by day desc, id) as place, '- ' || day || ': ' || statement as line from f where r = 1)
select * from p where place <= case part when 'open' then 12 else 8 end""",
    "waiting_counts": f"with {_ITEMS} select path, sum(case when ok then 0 when day > '2025-01-20' then 2 else 1 end)::bigint as waiting, count(*) filter (day > '2025-01-20') as repeated from i group by 1",
    "marked_done": f"with {_ITEMS} select path, id, case when length(id) % 2 = 0 then '2024-12-31' else '2025-06-01' end as at from i",
    "recap_window": """with p as (select '+/' || strftime(o_orderdate, '%Y-%m-%d') || case o_orderkey % 3 when 0 then ' — session ' else ' — harvest ' end || o_orderkey || '.md' as path, o_orderdate::date as day from orders where o_orderkey % 5 > 0 and o_orderkey % 3 < 2)
select path, day::varchar as day, row_number() over (order by path desc) as place from p where date_diff('day', day, date '1998-07-01') <= 14""",
    "located_quotes": f"""with {_LINES}, q as (select conv_id, conv_id * 1000 + turn as item_id, array_to_string(w[5:8], ' ') as q, turn + turn % 2 as cited from l where len(w) >= 12),
h as (select item_id, l.turn as line, role as speaker, q as said, row_number() over (partition by item_id order by l.turn = cited desc, l.turn) as r from q join l on l.conv_id = q.conv_id and contains(l.t, q.q))
select item_id, line, speaker, said from h where r = 1""",
    "chosen_sides": f"""with {_LINES}, s as (select *, not (conv_id % 2 = 0 and role = 'assistant' and turn % 8 <> 1) as got from l),
k as (select conv_id, role, sum(len(w)) as heard, coalesce(sum(len(w)) filter (got), 0) as got from s group by 1, 2)
select s.conv_id, s.role as speaker, s.turn as n, k.got < 0.3 * heard and heard > 0 as earlier from s join k on k.conv_id = s.conv_id and k.role = s.role where s.got or (k.got < 0.3 * heard and heard > 0)""",
    "longest_runs": rf"""with w as (select doc_id, regexp_extract_all(lower(replace(replace(text, 'İ', 'i'), 'I', 'ı')), '[\p{{L}}\p{{N}}_]+') as w from documents where text is not null)
select doc_id, greatest({', '.join(_RUN.format(n=n) for n in (1, 2, 3, 4))}) as run from w""",
    "made_up_lines": """select conv_id, turn, case (conv_id + turn) % 5 when 0 then true when 1 then len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) <= 6 when 2 then true else false end as made_up from conversations where text is not null""",
    "loop_windows": """with e as (select *, epoch_us(ts) / 60000000.0 - 28000000 as s, epoch_us(ts) / 60000000.0 - 28000000 + event_id % 40 as t from events)
select l.event_id as loop_id, g.event_id as segment_id from e l join e g on g.user_id = l.user_id and l.event_type = 'purchase' and g.event_type <> 'purchase' and g.t > l.s - 15 and g.s < l.t + 15""",
    "first_points": """with t as (select distinct conv_id, turn from conversations), k as (select conv_id, count(*) filter (turn % 4 = 0) as n from t group by 1),
p as (select t.conv_id, t.turn as line, (select count(*) from t s where s.conv_id = t.conv_id and s.turn % 4 = 0 and s.turn <= t.turn)::int as part, greatest(1, 8 // n) as quota from t join k using (conv_id) where n > 0)
select conv_id, line, part from (select *, row_number() over (partition by conv_id, part order by line) as r from p) where r <= quota""",
    "transcript_lines": """with r as (select conv_id, turn * 700 as s, role, text, row_number() over (partition by conv_id order by turn, role, text) as n from conversations where text is not null)
select conv_id, n, md5('- **[' || n || ' · ' || case when s >= 3600 then (s // 3600) || ':' || lpad((s // 60 % 60)::varchar, 2, '0') else (s // 60)::varchar end || ':' || lpad((s % 60)::varchar, 2, '0') || '] ' || case role when 'user' then 'Me' when 'assistant' then 'Others' else role end || ':** ' || text) as text_md5 from r""",
    "raw_transcripts": f"""with {_X}, g as (select *, conv_id % 3 = 0 as old, chr(35) || chr(35) || ' Exchange ' || i || chr(10) || chr(10) || '**Owner:** ' || u || chr(10) || chr(10) || '**Assistant:** ' || a as t from x)
select conv_id, not bool_or(old) as fresh, md5(string_agg(t, chr(10) || chr(10) order by i)) as text_md5 from g where not old or i > 2 group by 1""",
    "recap_texts": """with i as (select source, doc_id, case when quality = 0 then 4 when toxic = 1 then 1 when doc_id % 3 = 0 then 5 else 0 end as g, toxic, lang, quality from documents join labels using (doc_id)),
t as (select *, case when g in (4, 5) then '- document ' || doc_id || ' → [[note' || doc_id % 5 || ']]' else '- **' || case when doc_id % 2 = 0 then 'Decision' else 'Fact' end || case when doc_id % 6 = 0 then ' · assistant' else '' end || ':** document ' || doc_id || ' ↔ [[note' || doc_id % 5 || ']]'
  || chr(10) || '  > ' || lang || ' *(exchange ' || doc_id % 9 || ', owner' || case when doc_id % 4 = 0 then ', 2025-01-01' else '' end || ')*' || case when toxic = 1 then chr(10) || '  ≠ other' else '' end end as line from i),
p as (select source, g, '## ' || case g when 0 then 'New' when 1 then 'Conflicts with what is recorded' when 4 then 'Dropped' else 'Already recorded' end || chr(10) || chr(10) || string_agg(line, chr(10) order by doc_id) || chr(10) as text, count(*) as n from t group by 1, 2)
select source, md5('---' || chr(10) || 'type: output' || chr(10) || 'title: "Recap ' || source || '"' || chr(10) || 'description: "Recap ' || source || ': ' || coalesce(max(n) filter (g = 0), 0) || ' new, ' || coalesce(max(n) filter (g = 1), 0) || ' conflict, ' || coalesce(max(n) filter (g = 5), 0)
  || ' already recorded"' || chr(10) || 'created: 2025-01-02' || chr(10) || 'status: draft' || chr(10) || '---' || chr(10) || chr(10) || '# Recap ' || source || chr(10) || chr(10) || string_agg(text, chr(10) order by g)) as text_md5 from p group by source""",
    "day_logs": """with e as (select strftime(o_orderdate, '%Y-%m-%d') as day, string_agg('- **Decision' || case when o_orderkey % 2 = 0 then ' · not sure' else '' end || ':** order ' || o_orderkey, chr(10) || chr(10) order by o_orderkey) as t from orders where o_orderpriority = '1-URGENT' group by 1),
h as (select distinct strftime(o_orderdate, '%Y-%m-%d') as day, day(o_orderdate) % 2 = 0 as same from orders where year(o_orderdate) % 2 = 0)
select day, md5(case when same is null then '---' || chr(10) || 'type: daily' || chr(10) || 'created: ' || day || chr(10) || '---' || chr(10) || chr(10) || '# ' || day || chr(10) || chr(10) || '## Chats' || chr(10) || chr(10) || t || chr(10)
  when same then '# ' || day || chr(10) || chr(10) || '## Chats' || chr(10) || chr(10) || '- old' || chr(10) || t || chr(10)
  else '# x' || chr(10) || chr(10) || '## Other' || chr(10) || chr(10) || '- old' || chr(10) || chr(10) || '## Chats' || chr(10) || chr(10) || t || chr(10) end) as text_md5 from e left join h using (day)""",
    "unique_paths": """with p as (select p_partkey as id, 'A ' || string_split(p_name, ' ')[1] as stem from part), u as (select stem, count(distinct case when id % 20 = 0 then id else -1 end) as used from p where id % 10 = 0 group by 1),
n as (select id, p.stem, row_number() over (partition by p.stem order by id) + coalesce(used, 0) as n from p left join u on u.stem = p.stem) select id, 'notes/' || stem || case when n > 1 then ' (' || n || ')' else '' end || '.md' as path from n""",
    "raw_hidden_by_written_day": """with e as (select *, date_trunc('hour', ts) as h from events), w as (select distinct user_id, h from e where event_type = 'purchase')
select user_id, event_type, count(*) as n from e where event_type = 'purchase' or (event_type in ('view', 'click') and not exists (select 1 from w where w.user_id = e.user_id and w.h = e.h)) group by all""",
    "inside_then_outside": """with a as (select *, row_number() over (partition by o_orderpriority, year(o_orderdate) = 1996 order by o_totalprice desc, o_orderkey) as ri, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as ro, year(o_orderdate) = 1996 as inside from orders),
b as (select o_orderpriority, o_orderkey, ri as r, true as in_range from a where inside and ri <= 10 union all select o_orderpriority, o_orderkey, ro, false from a where ro <= 10 and not (inside and ri <= 10))
select o_orderpriority, o_orderkey, in_range, row_number() over (partition by o_orderpriority order by in_range desc, r, o_orderkey) as rank from b""",
}
