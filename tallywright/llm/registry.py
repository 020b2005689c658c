"""The queries of this subpackage and SQL for their results."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from functools import cache, wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import tallywright

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@cache
def _shipped(application: str) -> str:
    """A zip of the package for the Python workers, made once per application."""
    package = Path(tallywright.__file__).parent
    return shutil.make_archive(f"{tempfile.mkdtemp()}/tallywright", "zip", package.parent, package.name)


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that do not have it installed.

    Arrow batches of whole texts are kept to ``BATCH_ROWS`` rows: the default of 10,000 long texts is
    more than a task's memory on either side of the pipe.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    path = _shipped(spark.sparkContext.applicationId)
    if not any(file.endswith("/tallywright.zip") for file in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(path)


def query(name: str, sql: str | None = None, native: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``native`` ones run no Python on the executors."""

    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not native:
                ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a short scan (fewer tasks than cores) over all cores; long ones stay in place."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
