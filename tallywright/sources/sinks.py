"""Result sinks: JSON, CSV and a Markdown report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.metrics import all_metrics
from tallywright.sources.run_store import write_run

# The fields of a stored result, in order; the CSV leaves the details out.
RESULT_FIELDS = [
    "sample_id", "question", "evaluation_type", "difficulty", "model_response", "is_correct",
    "score", "execution_time", "error_message", "validation_details", "timestamp",
]
CSV_FIELDS = [f for f in RESULT_FIELDS if f != "validation_details"]


def _field(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string").alias(name)
    if name == "timestamp":
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
    return F.col(name)


def _stored(results: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    return results.select(*keys, *[_field(results, f) for f in fields])


def write_results_json(results: DataFrame, path: str, partition_by: str | None = "run_id") -> None:
    """One JSON object per result, all fields, in one folder per run; folders of other runs stay."""
    keys = [k for k in ("run_id", "model") if k in results.columns]
    writer = _stored(results, RESULT_FIELDS, keys).write.mode("overwrite").option("ignoreNullFields", False)
    if partition_by in keys:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.json(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    keys = [k for k in ("run_id", "model") if k in results.columns]
    _stored(results, CSV_FIELDS, keys).write.mode("overwrite").option("header", True).csv(path)


REPORT_COLUMNS = {
    "n": lambda r: f"{r.total_samples}",
    "right": lambda r: f"{r.correct_samples}",
    "share right": lambda r: f"{r.accuracy:.4f}",
    "mean score": lambda r: f"{r.average_score or 0:.4f}",
    "mean seconds": lambda r: f"{r.average_execution_time or 0:.3f}",
    "share failed": lambda r: f"{r.error_rate:.4f}",
}


def render_report(results: DataFrame, title: str = "Evaluation") -> str:
    """One Markdown table: a line for all results, then one per type and per difficulty.

    Only aggregate rows, at most a dozen, reach the driver.
    """
    rows = all_metrics(results).where(F.col("level").isin("overall", "type", "difficulty")).collect()
    place = {"overall": 0, "type": 1, "difficulty": 2}
    name = {"overall": lambda r: "all", "type": lambda r: r.evaluation_type, "difficulty": lambda r: r.difficulty}
    named = sorted((place[r.level], str(name[r.level](r)), r) for r in rows if r.total_samples)
    head = ["group", *REPORT_COLUMNS]
    lines = [f"# {title}", "", f"Written {dt.datetime.now():%Y-%m-%d %H:%M}", ""]
    lines += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for _, group, r in named:
        lines.append("| " + " | ".join([group, *[show(r) for show in REPORT_COLUMNS.values()]]) + " |")
    return "\n".join(lines)


def write_report(results: DataFrame, path: str, title: str = "Evaluation") -> str:
    """Write the report as one text file in ``path``, through Spark so any file system works."""
    text = render_report(results, title)
    spark = results.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def save_results(results: DataFrame, output_dir: str, prefix: str = "evaluation") -> dict[str, str]:
    """JSON, CSV and report of one evaluation, under names with the time of writing.

    The results also enter the store of runs below ``output_dir``, from which ``run_store.read_runs`` reads them.
    """
    stamp = f"{dt.datetime.now():%Y%m%d_%H%M%S}"
    base = f"{output_dir.rstrip('/')}/{prefix}"
    paths = {
        "runs_path": f"{output_dir.rstrip('/')}/{prefix}_runs",
        "json_path": f"{base}_results_{stamp}.json",
        "csv_path": f"{base}_results_{stamp}.csv",
        "report_path": f"{base}_report_{stamp}.md",
    }
    write_run(results, paths["runs_path"])
    write_results_json(results, paths["json_path"])
    write_results_csv(results, paths["csv_path"])
    write_report(results, paths["report_path"])
    return paths
