"""Recorded model answers as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSES = (
    "run_id string, sample_id string, model string, content string, prompt_tokens bigint, "
    "completion_tokens bigint, total_tokens bigint, execution_time_ms double, error string"
)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recorded answers with a fixed schema (no inference pass over the files)."""
    return normalise_responses(spark.read.format(fmt).schema(RESPONSES).load(path))


def normalise_responses(df: DataFrame) -> DataFrame:
    """Fill the total token count, and blank the text of answers that failed.

    An empty error text, as CSV and JSON exports hold it, is no error.
    """
    if "total_tokens" not in df.columns:
        df = df.withColumn("total_tokens", F.lit(None).cast("bigint"))
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    df = df.withColumn("error", F.when(F.trim("error") != "", F.col("error")))
    return df.withColumn(
        "total_tokens",
        F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")),
    ).withColumn("content", F.when(F.col("error").isNull(), F.col("content")).otherwise(""))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores if it has fewer partitions than there are cores.

    Text work is heavy per row, and a file with a single row group is one task. Large
    inputs come in many partitions and are left as they are, without a shuffle. For plain
    scans only: the number of partitions is read off the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
