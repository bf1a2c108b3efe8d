"""Result tables. A batch owns a partition and overwrites only that, so a replay is harmless."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TABLES = ["tier1_results", "iocs", "threat_intel", "reports", "incident_embeddings"]


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def write_batch(df: DataFrame, root: str, table: str, batch_id: int | str) -> None:
    """Write one batch of a result table, replacing an earlier attempt of the same batch."""
    path = f"{table_path(root, table)}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)


def _stored(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema + ", batch_id string").parquet(table_path(root, table))
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema + ", batch_id string")


def read_table(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A result table, empty while nothing has been written to it."""
    return _stored(spark, root, table, schema).drop("batch_id")


def read_other_batches(spark: SparkSession, root: str, table: str, schema: str, batch_id: int | str) -> DataFrame:
    """What other batches wrote; the own batch is left out since it is about to be replaced."""
    return _stored(spark, root, table, schema).filter(F.col("batch_id") != str(batch_id)).drop("batch_id")
