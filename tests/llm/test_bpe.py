import hashlib
import random

import numpy as np
import pytest

from passagework.llm import bpe, packing

PATH = bpe.tokenizer_file("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  a", "don't 'tis I'VE ''s a's's we'll", "x\n\n y\t", "²³ 漢字 😀 é", "<|endoftext|>", "a" * 5000, " 　 b", "1234 5,6", None]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def fuzz(n):
    r = random.Random(5)
    return ["".join(r.choice(" \n'strevmdlabAÉé1²x.!|%漢😀") for _ in range(r.randrange(60))) for _ in range(n)]


def test_round_trip(spark, documents, folder, library):
    texts = ODD + fuzz(400)
    where = folder(documents=documents(*enumerate(texts)))
    got = {r["doc_id"]: r for r in bpe.op10_bpe(spark, where).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_append_and_edit(library):
    encoder = bpe._prefix_encoder(PATH)[0]
    whole = lambda b: library._core_bpe.encode_single_piece(b)
    r, data = random.Random(3), b""
    table = bpe.PrefixTable(encoder)
    for _ in range(60):
        more = bytes(r.choice(b"the inonrestaz'") for _ in range(r.randrange(1, 5)))
        table.append(more)
        data += more
        assert table.tokens() == whole(data)
        a = r.randrange(len(data))
        b = min(len(data), a + r.randrange(4))
        table.edit(a, b, b"er")
        data = data[:a] + b"er" + data[b:]
        assert table.tokens() == whole(data)


def test_json_and_ranks_agree():
    assert bpe.read_ranks(bpe.tokenizer_file("byte_bpe_50k.json")) == bpe.read_ranks(PATH)


def test_packing(spark, documents, folder):
    import zlib
    from collections import defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    texts = [*ODD, *fuzz(150), "word and " * 3000, "x " * 1024]
    where = folder(documents=documents(*enumerate(texts)))
    t = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    rows = packing.op1_best_fit_packing(spark, where).collect()
    bins = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(map(len, ids.values())) // 1024) + 4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    import numpy as np

    limits = packing.Limits(tokens=100, documents=3, attention=4000, rule=rule)
    bins = packing.BestFit(limits)
    r = np.random.default_rng(1)
    load = {}
    for _ in range(5):
        lengths = r.integers(1, 60, 80)
        for s, n in zip(bins.place(lengths)[0].tolist(), lengths.tolist(), strict=True):
            a = load.setdefault(s, [0, 0, 0])
            a[0], a[1], a[2] = a[0] + n, a[1] + 1, a[2] + n * n
    assert all(a <= 100 and b <= 3 and c <= 4000 for a, b, c in load.values())
    with pytest.raises(ValueError):
        bins.place(np.array([101]))


def one_by_one(limits, lengths, state):
    """Best fit as it is defined: every piece looks at every open sequence. state: [residual, name] of open ones, and how many there were."""
    full = [limits.tokens, limits.documents, limits.attention]
    places = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, best = [lengths[i], 1, lengths[i] ** 2], None
        for k, (left, name) in enumerate(state["open"]):
            if all(a >= b for a, b in zip(left, need, strict=True)):
                if limits.rule == "norm":
                    score = sum((w * (a - b) / c) ** 2 for w, a, b, c in zip(limits.weights, left, need, full, strict=True))
                else:
                    score = -sum(w * (a / c) * (b / c) for w, a, b, c in zip(limits.weights, left, need, full, strict=True))
                if best is None or (round(score, 12), name) < best[:2]:
                    best = (round(score, 12), name, k)
        if best is None:
            state["open"].append((list(full), state["n"]))
            state["n"] += 1
            best = (0, state["n"] - 1, len(state["open"]) - 1)
        left, name = state["open"][best[2]]
        places[i] = (name, full[0] - left[0])
        for d in range(3):
            left[d] -= need[d]
    return places


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_equals_one_by_one_best_fit(rule):
    import numpy as np

    r = np.random.default_rng(11)
    for _ in range(30):
        limits = packing.Limits(tokens=int(r.integers(60, 200)), documents=int(r.integers(2, 9)), attention=int(r.integers(3600, 30_000)), rule=rule)
        bins, state = packing.BestFit(limits), {"open": [], "n": 0}
        for _ in range(4):
            lengths = r.integers(1, limits.longest() + 1, 60)
            got = list(zip(*(x.tolist() for x in bins.place(lengths)), strict=True))
            assert got == one_by_one(limits, lengths.tolist(), state)


def test_pieces_are_cut_by_every_capacity(spark, documents):
    limits = packing.Limits(tokens=1024, documents=5, attention=10_000)
    rows = packing.pack(documents((1, "a b " * 500), (2, None)), bpe.tokenizer_file("byte_bpe_50k.json"), limits=limits).collect()
    assert max(x["length"] for x in rows) == 100
    assert [x["length"] for x in sorted(rows, key=lambda x: x["piece"]) if x["doc_id"] == 1][1:] == [100] * (len([x for x in rows if x["doc_id"] == 1]) - 1)
    with pytest.raises(ValueError):
        packing.Limits(documents=0).longest()


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 40)
    r = random.Random(8)
    texts = ["".join(r.choice(" \n'strevmdlabAÉé1²x.!|%漢😀") for _ in range(500)) for _ in range(60)] + ["word " * 300, " " * 300, ""]
    ids, sizes = packing.token_ids(texts, bpe.tokenizer_file("byte_bpe_50k.json"), 2)
    want = [[*library.encode_ordinary(t), 2] for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_empty_tables_and_clashing_names(spark, documents, folder):
    docs = documents((3, "same id"), (3, "other text"), (3, "other text"), (None, "no id"))
    clash = docs.withColumn("ids", docs.n_chars).withColumn("data", docs.n_chars).withColumn("piece", docs.n_chars).withColumn("offset", docs.n_chars)
    for query, rows in ((bpe.op10_bpe, 4), (packing.op1_best_fit_packing, 4)):
        assert query(spark, folder(documents=clash)).count() == rows
        assert query(spark, folder(documents=clash.limit(0))).count() == 0


def test_steps_equal_the_round_trip(spark, documents):
    docs = documents(*enumerate(ODD))
    both = {r["doc_id"]: (bytes(r["ids"]), bytes(r["data"])) for r in bpe.round_trip(docs, PATH).collect()}
    assert both == {r["doc_id"]: (bytes(r["ids"]), bytes(r["data"])) for r in bpe.decode_column(bpe.encode_column(docs, PATH), PATH).collect()}


def test_every_prefix_has_its_own_last_token(library):
    encoder = bpe.PrefixEncoder(bpe.read_ranks(PATH))
    data = "kalirotens’ unsagbaresé 漢字".encode()
    last = encoder.extend(data, encoder.empty())[0]
    assert last[1:] == [library._core_bpe.encode_single_piece(data[:e])[-1] for e in range(1, len(data) + 1)]


def test_sequences_join_their_pieces(spark, documents):
    pieces = packing.pack(documents((1, "a b c"), (2, "d e")), bpe.tokenizer_file("byte_bpe_50k.json"))
    got = packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in got) == 4 * sum(r["length"] for r in pieces.collect())


def test_tails_of_many_tasks_are_packed_anew(spark):
    r = np.random.default_rng(3)
    rows, limits = [], packing.Limits(tokens=100, documents=6, attention=6000)
    for task in range(60):  # each task leaves sequences of its own half empty
        bins, lengths = packing.BestFit(limits), r.integers(1, 70, 25)
        rows += [(task * 100 + i, int(n), (task << 40) + int(s), int(o), f"kept {i}") for i, (n, s, o) in enumerate(zip(lengths, *bins.place(lengths), strict=True))]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, sequence_id long, offset long, more string")
    got = packing.refilled(pieces, limits)
    assert got.columns == pieces.columns
    after = got.collect()
    assert sorted((x["doc_id"], x["length"], x["more"]) for x in after) == sorted((x[0], x[1], x[4]) for x in rows)
    sequences = {}
    for x in after:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= 100 and len(parts) <= 6 and sum(n * n for _, n in parts) <= 6000
    together = packing.BestFit(limits).place(np.array([x[1] for x in rows]))[0].max() + 1  # all pieces in one task
    before = len({x[2] for x in rows})
    assert len(sequences) < before and len(sequences) <= together * 1.01
    assert packing.refilled(pieces.limit(0), limits).count() == 0
    assert packing.refilled(pieces.limit(1), limits).count() == 1
