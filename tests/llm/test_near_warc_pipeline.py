import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from passagework.llm import graph, near_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, n):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(pairs, n):
    """(doc_id, set size, component) by trying all pairs."""
    sets = [(i, shingles(t, n)) for i, t in pairs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    found = []
    for g in range(12):
        base = [word() for _ in range(r.randrange(6, 150))]
        for _ in range(r.randrange(1, 40 if g == 0 else 6)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = word()
            found.append(" ".join(w))
    found += [None, "", "  ", "one", "ONE", "one two", "One  two", "a b c d e", "a b c d e f", found[0].upper(), "k " * 50_000]
    return list(enumerate(found))


@pytest.mark.parametrize("small", [24, 2])
def test_near_dedup_equals_all_pairs(spark, documents, folder, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    pairs = texts()
    got = near_dedup.op7_minhash_near_dedup(spark, folder(documents=documents(*pairs).withColumn("digest", F.lit("clash"))))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(pairs, 2)


def test_near_dedup_edges(spark, documents):
    assert near_dedup.near_dedup(documents((1, "a")).limit(0)).count() == 0
    got = sorted(map(tuple, near_dedup.near_dedup(documents((3, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d e f"), (None, "a b c d e f"), (None, "x y z u v w"))).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (None, 3, False), (None, None, True)]
    kept = near_dedup.drop_near_copies(documents((3, "a b c d e f"), (5, "A b c d e f"), (6, "")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6]


def test_a_copy_takes_no_other_row_of_its_id_along(spark, documents):
    docs = documents((3, "a b c d e f"), (5, "A b c d e f"), (5, "u v w x y z"), (5, "u v w x y z"), (7, "u v w x y z"), (None, "a b c d e f"), (8, ""), (8, ""))
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(docs).collect()), key=str)
    assert kept == [(3, "a b c d e f"), (5, "u v w x y z"), (8, ""), (8, ""), (None, "a b c d e f")]


def test_long_lists_of_unlike_classes(spark, documents, monkeypatch):
    """A value that many unlike texts share makes one long list; it is compared in blocks, and the links are those of all pairs."""
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 16)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    pairs = []
    for i in range(0, 300, 2):
        own = [word() for _ in range(4)]
        pairs.append((i, " ".join(["the common words of all", *own])))
        if i % 10 == 0:
            pairs.append((i + 1, " ".join(["the common words of all", *own, word()])))
    got = near_dedup.near_dedup(documents(*pairs), 1)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(pairs, 1)


def test_structured_words_stay_apart(spark, documents):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    got = near_dedup.near_dedup(documents((1, f"x {word} y"), (2, f"x {word.translate(str.maketrans('ab', 'ba'))} y")), 2).collect()
    assert all(r["kept"] for r in got)


@pytest.mark.parametrize("share", [1000, 3])
def test_components_with_a_hub(spark, monkeypatch, share):
    """One node with most links, and chains that end in it."""
    attach = graph.attach
    monkeypatch.setattr(graph, "attach", lambda *a: attach(*a, share=share))
    links = [(500, i) for i in range(400)] + [(i, 1000 + i) for i in range(0, 400, 7)] + [(2000, 2001)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 2000} and len(got) == len({x for p in links for x in p}) and got[2001] == 2000 and got[1007] == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(90)], "a long, b long"))


def test_bits_lose_less_than_collisions():
    n, least, bits = near_dedup.COORDINATES, near_dedup.MATCHES, near_dedup.BITS
    share = [math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1)]
    fewer = lambda k: sum(math.comb(2 * (n - k), j) for j in range(max(0, min(2 * (n - k) + 1, bits - 2 * k)))) / 4 ** (n - k)
    assert sum(share[k] * fewer(k) for k in range(least, n + 1)) < sum(share[:least])


def pages(spark):
    big = "<html>" + "x" * 200 + "é</html>"
    rows = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", "y" * 400_000), (7, "u", "y" * 400_000), (8, "u", "WARC/1.1\r\n\r\n" + "z" * 99)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_warc_against_sql(spark, folder, duck):
    where = folder(pages=pages(spark).withColumn("refers_to", F.lit("clash")))
    got = sorted((r.asDict() for r in warc.op9_warc(spark, where).collect()), key=str)
    assert got == sorted(duck(warc.OP9_SQL, where, "pages"), key=str)
    assert sum(r["record_type"] == "revisit" for r in got) == 3
    assert warc.op9_warc(spark, folder(pages=pages(spark).limit(0))).count() == 0


def test_warc_of_a_page_id_with_two_payloads(spark, folder, duck):
    a, b = "a" * 200, "b" * 200
    where = folder(pages=spark.createDataFrame([(1, "u", a), (5, "u", a), (5, "u", b), (7, "u", b), (7, "u", b)], "page_id long, url string, html string"))
    got = sorted((r.asDict() for r in warc.op9_warc(spark, where).collect()), key=str)
    assert got == sorted(duck(warc.OP9_SQL, where, "pages"), key=str)
    assert sorted((r["page_id"], r["refers_to"] or 0) for r in got) == [(1, 0), (5, 0), (5, 1), (7, 5), (7, 5)]


def test_bundles_are_standard_and_seekable(spark, tmp_path):
    import io

    import zstandard

    path = str(tmp_path / "w")
    warc.write(pages(spark), path)
    for row in spark.read.parquet(path).collect():
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(row["data"])), read_across_frames=True).read()
        frames = warc.read_seek_table(bytes(row["data"]))
        assert len(whole) == sum(f[2] for f in frames) and whole.count(b"WARC/1.1\r\nWARC-Type") == len(row["records"])
    got = {r["page_id"]: bytes(r["content"]) for r in warc.fetch(spark, path, spark.createDataFrame([(2,), (9,), (6,)], "page_id long")).collect()}
    assert got[9] == got[2] and got[6] == b"y" * 400_000 and got[2].endswith("é</html>".encode())
    assert all(r["payload_digest"] == hashlib.sha256(bytes(r["content"])).hexdigest() for r in warc.read(spark, path).where("record_type = 'response'").collect())


def test_every_record_has_an_id_of_its_own(spark, tmp_path):
    rows = [(None, "u", "a" * 200), (None, "u", "a" * 200), (3, "u", "b"), (3, "u", "b"), (3, "u", "c"), (4, "u", "d" * 200), (5, "u", "d" * 200)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1)), path)
    import io

    import zstandard

    heads = []
    for row in spark.read.parquet(path).collect():
        data, at = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(row["data"])), read_across_frames=True).read(), 0
        while at < len(data):
            head, _, at = warc.parse(data, at)
            heads.append(head)
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(rows)
    revisit = next(h for h in heads if h["WARC-Type"] == "revisit")
    assert ids[revisit["WARC-Refers-To"]]["Page-Id"] == "4"
    asked = spark.createDataFrame([(None,), (3,)], "page_id long")
    assert sorted(bytes(r["content"])[:1] for r in warc.fetch(spark, path, asked).collect()) == [b"a", b"a", b"b", b"b", b"c"]


def test_fetch_follows_revisits_by_record_and_by_page(spark, tmp_path):
    rows = [(4, "u", "d" * 200), (4, "u", "d" * 200), (5, "u", "d" * 200), (6, "v", "d" * 200), (5, "u", "e"), (7, "w", None), (None, "u", "d" * 200)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    ids = lambda kind, *values: spark.createDataFrame([(v,) for v in values], kind)
    by_page = warc.fetch(spark, path, ids("page_id long", 5, 6, 6, 7, 99)).collect()
    assert sorted((r["page_id"], bytes(r["content"])) for r in by_page) == [(5, b"d" * 200), (5, b"e"), (6, b"d" * 200), (7, b"")]
    every = [r["record_id"] for r in spark.read.parquet(path).select(F.inline("records")).collect()]
    assert len(set(every)) == len(rows)
    by_record = warc.fetch(spark, path, ids("record_id string", *every)).collect()
    assert sorted((r["record_id"], len(r["content"])) for r in by_record) == sorted((r["record_id"], len(r["content"])) for r in warc.fetch(spark, path, ids("page_id long", 4, 5, 6, 7, None)).collect())
    assert sorted(len(r["content"]) for r in by_record) == [0, 1, 200, 200, 200, 200, 200]
    assert warc.fetch(spark, path, ids("page_id long", 1)).count() == 0


def test_exported_bundles_are_read_by_the_plain_format(spark, tmp_path):
    import io

    import zstandard

    path, folder = str(tmp_path / "w"), str(tmp_path / "files")
    warc.write(pages(spark).repartition(2), path)
    told = {r["bundle"]: r["bytes"] for r in warc.export(spark, path, folder).collect()}
    assert told == {f.name: f.stat().st_size for f in (tmp_path / "files").iterdir()}
    found = []
    for file in (tmp_path / "files").iterdir():
        data, at = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read_bytes()), read_across_frames=True).read(), 0
        while at < len(data):
            head, content, at = warc.parse(data, at)
            found.append((head["Page-Id"], content))
    assert sorted(found) == sorted((str(r["page_id"]), bytes(r["content"])) for r in warc.read(spark, path).collect())


def test_pipeline_keeps_unlike_rows_of_one_id(spark, documents, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(70))
    a, b, c = text(), text(), text()
    docs = documents((5, a), (7, a.upper()), (5, b), (9, c), (9, c), (3, b + " tail"), (None, c), (None, None))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = corpus_pipeline.run(spark, folder(documents=docs.withColumn("digest", F.lit("clash")), labels=labels)).collect()
    # of a the row of 7 stays; b and its near copy are one group, of which 3 stays; c once, by the row that has an id
    assert sorted(x["doc_id"] for x in got) == [3, 7, 9]


def test_pipeline_equals_brute_force(spark, documents, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(90)) for _ in range(30)]
    pairs = [(i, t) for i, t in enumerate(base)]
    pairs += [(100, base[0].upper()), (101, base[1] + " tail"), (102, "too short"), (103, base[2].replace(" ", "%% ")), (104, base[3] + " token = abcdefgh9"), (105, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    where = folder(documents=documents(*pairs), labels=labels)
    got = corpus_pipeline.run(spark, where).collect()
    kept = {i: t for i, t in pairs if t and len(WORD.findall(t)) >= 50}
    best = {}
    for i, t in kept.items():
        best[t.translate(LOW)] = max(i, best.get(t.translate(LOW), -1))
    kept = {i: kept[i] for i in best.values()}
    kept = {i: kept[i] for i, _, c, keep in brute(list(kept.items()), 5) if keep}
    assert {x["doc_id"] for x in got} == set(kept)
    assert sum(x["length"] for x in got) > 0
    docs = documents(*pairs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns, name
        docs = out
