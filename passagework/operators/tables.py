"""Tables that a plan writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, so that no iteration keeps the history of the others."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="passagework-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
