from pyspark.sql import functions as F

from passagework.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_sql_with_edges(spark, folder, duck):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "system", "<s>[INST]</loss>\\<s>\\\\"), (2, 1, "assistant", "\\</s> [\\INST] <loss>x</loss> é😀\n"), (2, 1, "assistant", "same turn"), (2, 1, "assistant", "same turn"),
        (3, 5, None, "role is null"), (4, 0, "[/INST]odd", "</s>"), (5, 0, "assistant", "a" * 200_000), (6, 700, "user", "late"), (6, 2, "user", "early"), (None, 0, "user", "no id"), (8, 0, "assistant", ""),
    ]
    where = folder(conversations=spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("formatted", F.lit("clash")))
    got = sorted((r.asDict() for r in chat.op3_chat_formatting(spark, where).collect()), key=str)
    assert got == sorted(duck(chat.OP3_SQL, where, "conversations"), key=str)
    assert {r["conv_id"] for r in got} == {1, 2, 3, 4, 5, 6, 8, None, -7}


def test_empty(spark, folder):
    where = folder(conversations=spark.createDataFrame([], SCHEMA))
    assert [r["conv_id"] for r in chat.op3_chat_formatting(spark, where).collect()] == [-7]


def test_fold(spark):
    log = spark.createDataFrame([
        (1, 0, 0, 0, "message", "user", "helo"), (1, 0, 0, 1, "edit", None, "hello"),
        (1, 1, 0, 2, "message", "assistant", ""), (1, 1, 0, 3, "delta", None, "wr"), (1, 1, 0, 4, "delta", None, "ong"), (1, 1, 0, 5, "regenerate", None, None), (1, 1, 0, 6, "delta", None, "ri"), (1, 1, 0, 7, "delta", None, "ght"),
        (1, 2, 0, 8, "message", "user", "oops"), (1, 2, 0, 9, "retract", None, None), (1, 3, 0, 10, "noise", "user", "ignored"),
    ], "conv_id int, turn int, place int, seq int, kind string, role string, text string")
    got = sorted((r["turn"], r["role"], r["text"]) for r in chat.rebuilt(log).collect())
    assert got == [(0, "user", "hello"), (1, "assistant", "right")]
    out = chat.format_chats(log).first()
    assert [out["formatted"][s["start"] : s["end"]] for s in out["loss_spans"]] == ["right"]


def test_turns_become_logs_that_are_folded(spark):
    said = [(1, 0, "user", "a\n\nb\n"), (1, 1, "assistant", ""), (1, 1, "assistant", "\n")]
    log = chat.as_events(spark.createDataFrame(said, SCHEMA))
    steps = [tuple(r) for r in log.where("turn = 0").orderBy("seq").select("kind", "role", "text").collect() if r["text"] or r["kind"] != "delta"]
    assert steps == [("message", "user", "a\n\nb\n"), ("edit", None, ""), ("delta", None, "a\n"), ("delta", None, "\n"), ("delta", None, "b\n")]
    assert {"message", "delta", "regenerate"} == {r["kind"] for r in log.where("turn = 1").collect()}
    assert log.select("conv_id", "seq").distinct().count() == log.count()
    assert sorted((r["turn"], r["role"], r["text"]) for r in chat.rebuilt(log.repartition(3)).collect()) == [x[1:] for x in said]
    alone = spark.createDataFrame([(1, 0, 0, 0, "retract", "user", "gone"), (1, 1, 0, 1, "delta", "user", "stays")], "conv_id int, turn int, place int, seq int, kind string, role string, text string")
    assert [(r["turn"], r["text"]) for r in chat.rebuilt(alone).collect()] == [(1, "stays")]


def test_long_conversation_in_blocks(spark):
    turns = spark.range(1000).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text")).withColumnRenamed("id", "turn")
    out = chat.read_back(chat.format_chats(chat.as_events(turns))).first()
    assert [t["text"] for t in out["turns"]] == [str(i) for i in range(1000)]
    assert out["loss_texts"] == [str(i) for i in range(1, 1000, 2)]
