"""Python stages get small batches, whatever the size of a table."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework import session
from passagework.operators import gates, lexical, vectors
from passagework.sources import notes

LIMIT = session._LIMIT


@pytest.fixture
def unset(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


STAGES = {
    "parsed": lambda d: notes.parsed(d, "text"),
    "hash_embedding": lambda d: vectors.hash_embedding(d, "id", "text", 8),
    "found": lambda d: lexical.found(d, "id", "text", ["a"]),
    "scored": lambda d: gates.scored(d, "text", "text", lambda: lambda q, t: [0.0] * len(t)),
}


@pytest.mark.parametrize("name", STAGES)
def test_batches_have_few_bytes(spark, unset, name):
    d = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("a b "), 1000).alias("text"))
    assert STAGES[name](d).count() == 3000

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    most, n = d.mapInArrow(sizes, "bytes long").agg(F.max("bytes"), F.count("bytes")).first()
    assert most <= session.BATCH_BYTES + 10_000 and n >= 3


def test_a_limit_of_the_session_stays(spark, unset):
    spark.conf.set(LIMIT, "1m")
    session.small_batches(spark)
    assert spark.conf.get(LIMIT) == "1m"
