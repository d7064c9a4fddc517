import duckdb
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) pairs, in two partitions."""

    def make(*pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS).repartition(2)

    return make


@pytest.fixture
def folder(tmp_path):
    """Write tables as folders of Parquet files where queries expect them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def duck():
    """Rows of a DuckDB statement over the Parquet tables of a folder."""

    def run(sql, where, *names):
        con = duckdb.connect()
        for n in names:
            con.execute(f"create view {n} as select * from '{where}/{n}.parquet/*.parquet'")
        return con.execute(sql).to_arrow_table().to_pylist()

    return run
