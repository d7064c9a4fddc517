import pytest
from pyspark.sql import functions as F

from passagework.functions import front as fm
from passagework.functions import text
from passagework.operators import evaluation, labels, meetings, ranking, vault, work, writers
from passagework.sources.notes import front_matter


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_front_views(spark):
    x = F.col("x")
    assert [tuple(s) for s in one(spark, fm.source_entries(x), '{"sources":[{"resource":"a.md","title":"A"},["[b]"],"c",{"title":"no"}," "]}')][0] == ("a.md", "A")
    assert one(spark, fm.source_refs(x), '{"sources":"[[N]]"}') == ["[[N]]"] and one(spark, fm.source_refs(x), "{}") == []
    assert one(spark, fm.generated(x), '{"generated":{"by":"c/1"}}')["by"] == "c/1" and one(spark, fm.generated(x), '{"generated":"c"}') is None
    assert one(spark, fm.is_recap(x), '{"harvest":{"extractor":"y"}}') and not one(spark, fm.is_recap(x), '{"session":"y"}')
    assert one(spark, fm.as_wikilink(x), "/a/b.md") == "[[b]]" and one(spark, fm.as_wikilink(x), "http://a/b.md") == "http://a/b.md"
    assert tuple(one(spark, fm.ref_entry(x, F.lit("s")), "s:a/b.md")) == ("/a/b.md", "b") and tuple(one(spark, fm.ref_entry(x, F.lit("t")), "s:a/b.md")) == ("s:a/b.md", "b")
    assert one(spark, fm.is_reserved(F.lit("a/index.md"), x), "{}") and not one(spark, fm.is_reserved(F.lit("index.md"), x), '{"type":"note"}')
    assert [one(spark, fm.excluded(F.lit(p), ["drafts", "*.tmp.md", "9?"]), "") for p in ("drafts/a.md", "x/a.tmp.md", "a.md", "drafts.md", "90", "190", "901")] == [True, True, False, False, True, False, False]
    assert one(spark, fm.safe_title(x), ' ..a/b: "c"\n.. ') == "a b c" and one(spark, fm.safe_title(x), "...") == "Untitled"


@pytest.mark.parametrize("value", ["plain", "on", "3.5", 'a: "b" # c', "x\ny: z", "- a", "é"])
def test_written_front_matter_reads_back(spark, value):
    block = one(spark, fm.yaml_block({"v": (F.col("x"), "string"), "l": (F.array("x", F.lit("b")), "array"), "m": (F.struct(F.col("x").alias("k")), "map"), "none": (F.lit(None).cast("string"), "string")}), value)
    assert front_matter(block + "\nbody") == ({"v": value, "l": [value, "b"], "m": {"k": value}}, "body")


def test_approval_changes_its_own_lines_only(spark):
    approve = lambda raw: one(spark, fm.approved(F.col("x"), F.lit("human:a"), F.lit("2025-01-01")), raw)
    assert approve("---\nstatus: draft\nverified: {by: bot}\n---\ndraft: true\n") == '---\nstatus: stable\nverified: [{by: bot}, {"by":"human:a","at":"2025-01-01"}]\n---\ndraft: true\n'
    assert approve("---\ntype: x\n---\nstatus: draft") is None and approve("status: draft") is None


def test_names_of_one_person(spark, rows):
    d = spark.createDataFrame([("Deniz Kaya",), ("deniz kaya",), ("Deniz",), ("Can",), ("Can Su",), ("Can Ay",), (" ",)], "name string")
    assert rows(vault.names(d)) == sorted([("deniz kaya", "Deniz Kaya", 3), ("can", "Can", 1), ("can su", "Can Su", 1), ("can ay", "Can Ay", 1)], key=repr)


def test_small_words(spark):
    x = F.col("x")
    assert one(spark, text.plain_key(x), "Çağrı İşbilir ß") == "Cagri Isbilir "
    names = F.array(F.lit("İsmail Ak"), F.lit("Deniz Kaya"), F.lit("Deniz Kayalar"))
    assert [one(spark, text.guessed_name(x, names), m) for m in ("ismaily@x", "deniz.kaya@x", "deniz@x", "zoe@x", None)] == ["İsmail Ak", "Deniz Kaya", "Deniz Kayalar", "", ""]
    assert [one(spark, work.is_done_list(x), n) for n in ("Done", "Not done", "To be completed", "Bitti!", "Tamamlanacaklar", None)] == [True, False, False, True, False, False]
    assert [one(spark, work.handed_to(x, ["for {name}", "over to {name}"], F.lit("Can Kaya")), t) for t in ("Report for Can, now", "for Ercan", "OVER  TO can", "for")] == [True, False, True, False]
    assert [one(spark, work.owned_by(x, F.lit("Can Kaya")), o) for o in ("Ann, can", "tbd", "Ercan", None)] == [True, False, False, None]
    assert [one(spark, meetings.longest_run(x), t) for t in ("a b c", "no no no", "a b a b a b c", "x a b c a b c a b", "", "I ı i")] == [1, 3, 3, 2, 1, 2]
    assert [one(spark, meetings.made_up(x), t) for t in ("Thanks for watching!", "altyazı", "M. K. ile görüştük", "this is a real sentence of many words that says thanks for watching")] == [True, True, True, False]
    assert one(spark, meetings.minutes(F.lit(20.0)), "") == 1


def test_quotes_in_lines(spark, rows):
    lines = spark.createDataFrame([("m", 1, "me", "0:01", "Yarın yayına çıkıyoruz, tamam mı?"), ("m", 2, "others", "0:02", "the new build ships on friday"), ("m", 3, "me", "0:03", "so the new build ships today")], "m string, n int, speaker string, at string, text string")
    items = spark.createDataFrame([("m", 1, "summary", "a", "yarin yayina cikiyoruz", 2), ("m", 2, "fact", "b", "New build ships", 3), ("m", 3, "fact", "c", "two words", 1), ("m", 4, "fact", "d", "never was said", 1), ("m", 5, "fact", "B", "new build ships", None), ("m", 6, "rumour", "e", "new build ships", 2)], "m string, item_id int, type string, statement string, quote string, cited int")
    got = {r["item_id"]: (r["line"], r["said"]) for r in meetings.located(items, lines, "m").collect()}
    assert got == {1: (1, "yarın yayına çıkıyoruz"), 2: (3, "new build ships"), 5: (2, "new build ships"), 6: (2, "new build ships")}
    assert {r["item_id"] for r in meetings.checked(items, lines, "m").collect()} == {1, 2}


def test_topic_names(spark):
    said = [("a", i, f"mac mini setup {w}") for i, w in enumerate(("one", "two", "three", "four", "five"))] + [("b", i + 10, f"garden plan {w}") for i, w in enumerate(("red", "blue", "green", "grey", "pink"))]
    said += [("c", i + 20, w) for i, w in enumerate(["alpha zebra", "beta zebra", "gamma", "delta"] * 5)]
    d = spark.createDataFrame(said, "g string, k int, title string")
    got = {r["g"]: r["label"] for r in labels.names(labels.ranked_terms(d, "g", "k", F.col("title"), ["setup"]), "g").collect()}
    assert got["a"] == "Mac mini" and got["b"] == "Garden plan"


def test_logs_grow(spark):
    entries = spark.createDataFrame([("d1", 2, "- two"), ("d1", 1, "- one"), ("d2", 1, "- x")], "day string, id int, line string")
    held = spark.createDataFrame([("d1", "# d1\n\n## Chats\n\n- zero\n\n\n")], "day string, text string")
    once = {r["day"]: r["text"] for r in writers.logs(entries, held, "Chats").collect()}
    assert once["d1"] == "# d1\n\n## Chats\n\n- zero\n- one\n\n- two\n" and once["d2"].endswith("# d2\n\n## Chats\n\n- x\n")


def test_running_total_over_ranges(spark):
    d = spark.range(500).repartition(7).select(((F.col("id") * 37) % 500).alias("k"), (F.col("id") % 5 + 1).alias("n"))
    want, total = [], 0
    for k, n in sorted((k, n) for k, n in (((i * 37) % 500, i % 5 + 1) for i in range(500))):
        total += n
        if total <= 700:
            want.append((k, total))
    assert sorted((r["k"], r["running"]) for r in ranking.within_running_total(d, ["k"], F.col("n"), 700).collect()) == want


def test_evaluation(spark, rows):
    kind = "qid string, question string, answerable string, confirmed boolean, expected array<struct<source:string,name:string>>"
    q = spark.createDataFrame([("1", "what is the plan now", "yes", True, [("*", "b")]), ("2", "x", "no", False, []), ("3", "y", "partial", False, [("s", "a/c.md")])], kind)
    e = spark.createDataFrame([("1", 1, "s", "a.md", "chat-raw", "he asked: What is  the plan now?"), ("1", 2, "s", "a.md", "note", "x"), ("1", 3, "s", "x/b.md", "note", "y"), ("3", 1, "t", "a/c.md", "note", "z")], "qid string, place int, source_id string, path string, kind string, shown string")
    scores = evaluation.scored(q, e)
    assert rows(scores.select("qid", "found", "rank", "files", "echo")) == [("1", True, 2, 2, 1), ("2", False, None, 0, 0), ("3", True, None, 1, 0)]
    s = evaluation.summary(scores).first()
    assert (s["hit1"], s["hit3"], s["mrr"], s["abstained"], s["unanswerable"], s["false_none"]) == (0, 1, 0.25, 1, 1, 0)
    assert evaluation.replayed(q, e).count() == 2
