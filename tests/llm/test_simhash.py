import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from passagework.llm import simhash as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, n_words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + n_words]) for i in range(max(1, len(w) - n_words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(pairs, radius=4):
    """Brute force: all pairs, then components."""
    marks = [plain_fingerprint(t) for _, t in pairs]
    part = list(range(len(pairs)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                part[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, f"{marks[i]:016x}", ids.get(top(i))) for i, (d, _) in enumerate(pairs)), key=repr)


def answered(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Word", "中文"]
    found = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 400))]
        found.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            found.append(rng.choice([" ", "\n", " \t "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return found


def test_against_all_pairs(spark, documents, texts):
    pairs = [*enumerate(texts, 10), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, texts[0]), (None, "no id at all"), (7, "a"), (7, "b"), (7, "b"), (8, "x y " * 60_000)]
    got = answered(op.simhash_near_dedup(documents(*pairs).withColumn("fingerprint", F.lit("clash")).withColumn("least", F.lit(0))))
    assert got == plain(pairs)
    assert len({c for _, _, c in got}) < len(got) - 20  # near copies were linked


def test_every_link_within_the_radius_is_found(spark):
    rng = random.Random(1)
    marks = [0, (1 << 64) - 1]
    for _ in range(40):
        base = rng.getrandbits(64)
        marks += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(6)]
    marks = sorted(set(marks))
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    got = {frozenset((a % (1 << 64), b % (1 << 64))) for a, b in map(tuple, op.links(spark.createDataFrame([(m,) for m in signed], "fingerprint bigint"), 4).collect())}

    def parts(links):
        part = {m: m for m in marks}
        for _ in marks:
            for a, b in links:
                part[a] = part[b] = min(part[a], part[b])
        return part

    assert parts([tuple(p) for p in got]) == parts([(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 4])


def test_hot_buckets_in_slices(spark, monkeypatch):
    monkeypatch.setattr(op, "SLICE_VARIANTS", 20_000)
    monkeypatch.setattr(op, "BUCKET_VARIANTS", 1 << 30)
    rng = random.Random(2)
    base = rng.getrandbits(62)
    marks = sorted({base ^ sum(1 << b for b in rng.sample(range(60), 2)) for _ in range(200)} | {rng.getrandbits(62) for _ in range(50)})
    got = op.links(spark.createDataFrame([(m,) for m in marks], "fingerprint bigint"), 4).collect()
    near = {m for m in marks if (m ^ base).bit_count() == 2}
    assert {x for r in got for x in r} == near
    assert len(got) < 12 * len(near)  # a forest for each bucket, not all pairs


def test_variants_are_the_whole_ball():
    mark = np.array([0x0123456789ABCDEF], np.uint64)
    found = [int(v) for b in range(16) for _, part in op.variants(mark, b, 4, 2) for v in part]
    assert len(found) == len(set(found)) == 1 + 64 + 2016
    assert all((v ^ int(mark[0])).bit_count() <= 2 for v in found)


def test_hashes_and_edges(spark, documents):
    values, first = op.shingle_hashes(pa.array(["A  b\tC d\ne", None, "é"], pa.large_string()).fill_null(""), 4)
    assert values.tolist() == [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c d", "b c d e", "é")] and first.tolist() == [0, 2, 2, 3]
    assert op.simhash_near_dedup(documents((1, "a")).limit(0)).count() == 0
    with pytest.raises(ValueError):
        op.simhash_near_dedup(documents((1, "a")), radius=3)
