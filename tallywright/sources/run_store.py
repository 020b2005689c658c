"""A store of evaluation results by run and model.

A write puts its rows below a version of its own, one folder per run and model, and then commits them by one
small file: the cells of its metrics. Only committed rows are read, and of a run and model only those of the latest
commit, so an unfinished write is never seen, a rewritten run replaces its older rows and leaves all others,
and a write that is tried again does no harm. Reports on whole runs merge the cells and read
no result at all.

Reading named runs prunes folders by run and version. Null runs and models are stored and read back. ``sample_id``
keeps the type of the first write.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallywright.operators.metrics import metric_cells

KEYS = ["run_id", "model"]
FOLDERS = [*KEYS, "version"]
CELLS = (
    "run_id string, model string, version string, evaluation_type string, difficulty string, n bigint, correct bigint, "
    "score decimal(38,9), scored bigint, time decimal(38,9), timed bigint, errors bigint"
)


def _new_version() -> str:
    """Later versions sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def stage_run(results: DataFrame, path: str, version: str | None = None) -> str:
    """Write rows without committing them; returns their version. The same version may be written again."""
    version = version or _new_version()
    rows = results
    for key in KEYS:
        rows = rows.withColumn(key, F.col(key).cast("string") if key in rows.columns else F.lit(None).cast("string"))
    writer = rows.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*FOLDERS).parquet(f"{path.rstrip('/')}/results")
    return version


def commit_run(spark: SparkSession, path: str, version: str) -> None:
    """Make the rows of a version visible: its cells are computed from what was written, and stored in one file."""
    written = _results(spark, path).where(F.col("version") == version)
    cells = metric_cells(written, FOLDERS).select(*[c.split()[0] for c in CELLS.split(", ")])
    cells.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")


def write_run(results: DataFrame, path: str) -> str:
    """Store results under their runs and models; rows of the same run and model from before are replaced."""
    version = stage_run(results, path)
    commit_run(results.sparkSession, path, version)
    return version


def _results(spark: SparkSession, path: str) -> DataFrame:
    """All rows, committed or not; folder names are text, whatever they look like."""
    root = f"{path.rstrip('/')}/results"
    found = spark.read.parquet(root).schema
    schema = StructType([f for f in found if f.name not in FOLDERS] + [StructField(k, StringType()) for k in FOLDERS])
    return spark.read.schema(schema).parquet(root)


def committed_cells(spark: SparkSession, path: str, run_ids: list[str] | None = None) -> DataFrame:
    """The cells of the latest commit of each run and model."""
    cells = spark.read.schema(CELLS).parquet(f"{path.rstrip('/')}/commits").distinct()
    if run_ids is not None:
        cells = cells.where(F.col("run_id").isin(*run_ids))
    latest = cells.groupBy(*KEYS).agg(F.max("version").alias("_latest")).select(*[F.col(k).alias(f"_{k}") for k in KEYS], "_latest")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    return cells.join(latest, [*same, F.col("version") == F.col("_latest")], "left_semi")


def read_runs(spark: SparkSession, path: str, run_ids: list[str] | None = None) -> DataFrame:
    """Committed results of the named runs, or of all; only their folders are listed in the plan."""
    latest = committed_cells(spark, path, run_ids).select(*[F.col(k).alias(f"_{k}") for k in FOLDERS]).distinct()
    rows = _results(spark, path)
    if run_ids is not None:
        # At most one version per named run and model.
        versions = [r[0] for r in latest.select("_version").distinct().collect()]
        rows = rows.where(F.col("run_id").isin(*run_ids) & F.col("version").isin(*versions))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FOLDERS]
    return rows.join(latest, same, "left_semi").drop("version")


def remove_superseded(spark: SparkSession, path: str) -> int:
    """Delete folders whose rows a later commit has replaced; returns their number. Uncommitted ones stay."""
    cells = spark.read.schema(CELLS).parquet(f"{path.rstrip('/')}/commits")
    old = cells.select(*FOLDERS).distinct().withColumn("latest", F.max("version").over(_by_key())).where("version < latest")
    kept = old.select(*[F.col(k).alias(f"_{k}") for k in FOLDERS])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FOLDERS]
    files = _results(spark, path).withColumn("_file", F.input_file_name()).join(kept, same, "left_semi").select("_file").distinct()
    folders = {file.rsplit("/", 1)[0] for (file,) in files.toLocalIterator()}
    for folder in sorted(folders):
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(folders)


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy(*KEYS)
