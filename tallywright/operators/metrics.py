"""Aggregates over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6
MEAN_TYPE = "decimal(18,9)"
EVALUATION_TYPES = {
    "sql": ["sql"],
    "function": ["function"],
    "mixed": ["sql", "function"],
    "full": ["sql", "function"],
}


def _rounded(value: Column) -> Column:
    return F.round(value, DIGITS)


def mean(value: Column | str) -> Column:
    """Mean through exact decimals, so it does not depend on the order of rows."""
    return F.avg(F.col(value).cast(MEAN_TYPE) if isinstance(value, str) else value.cast(MEAN_TYPE)).cast("double")


def _share(part: Column) -> Column:
    return _rounded(F.coalesce(F.try_divide(part, F.count("*")), F.lit(0.0)))


def metric_columns(error_rate: bool = True) -> list[Column]:
    """Counts, accuracy, mean score and time, and the share of rows with an error message."""
    out = [
        F.count("*").alias("total_samples"),
        F.count_if("is_correct").alias("correct_samples"),
        _share(F.count_if("is_correct")).alias("accuracy"),
        _rounded(mean("score")).alias("average_score"),
        _rounded(mean("execution_time")).alias("average_execution_time"),
    ]
    if error_rate:
        out.append(_share(F.count("error_message")).alias("error_rate"))
    return out


def overall_metrics(results: DataFrame) -> DataFrame:
    """One row of metrics, or none for an empty input."""
    return results.agg(*metric_columns()).where("total_samples > 0")


def metrics_by(results: DataFrame, *keys: str, error_rate: bool = True) -> DataFrame:
    return results.groupBy(*keys).agg(*metric_columns(error_rate))


def detailed_breakdown(results: DataFrame) -> DataFrame:
    return metrics_by(results, "evaluation_type", "difficulty", error_rate=False)


CELL_KEYS = ["evaluation_type", "difficulty"]
#: Sums of a cell; cells of the same group merge by adding them up.
CELL_SUMS = ["n", "correct", "score", "scored", "time", "timed", "errors"]
SUM_TYPE = "decimal(38,9)"


def metric_cells(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One mergeable row per type and difficulty, and per ``by``: counts and exact sums."""
    return results.groupBy(*(by or []), *CELL_KEYS).agg(
        F.count("*").alias("n"),
        F.count_if("is_correct").alias("correct"),
        F.sum(F.col("score").cast(MEAN_TYPE)).cast(SUM_TYPE).alias("score"),
        F.count("score").alias("scored"),
        F.sum(F.col("execution_time").cast(MEAN_TYPE)).cast(SUM_TYPE).alias("time"),
        F.count("execution_time").alias("timed"),
        F.count("error_message").alias("errors"),
    )


def all_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overall, per type, per difficulty and per both, from one scan.

    ``level`` tells which; ``by`` adds keys, such as the run or the model, to every level.
    Results are first reduced to one row per type and difficulty; the four levels are sums
    over those few rows, where grouping sets alone would copy every result four times.
    """
    return metrics_of_cells(metric_cells(results, by), by)


def _ratio(part: str, whole: str) -> Column:
    return _rounded(F.try_divide(F.sum(part).cast("double"), F.sum(whole)))


def metrics_of_cells(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``all_metrics`` from cells, which may come from several writes."""
    t, d = F.col("evaluation_type"), F.col("difficulty")
    extra = [F.col(c) for c in by or []]
    grouped = cells.groupingSets([extra, [*extra, t], [*extra, d], [*extra, t, d]], *extra, t, d)
    no_type, no_difficulty = F.grouping("evaluation_type"), F.grouping("difficulty")
    level = (
        F.when((no_type == 1) & (no_difficulty == 1), "overall")
        .when(no_difficulty == 1, "type")
        .when(no_type == 1, "difficulty")
        .otherwise("type_difficulty")
    )
    return grouped.agg(
        level.alias("level"),
        F.sum("n").alias("total_samples"),
        F.sum("correct").alias("correct_samples"),
        _ratio("correct", "n").alias("accuracy"),
        _ratio("score", "scored").alias("average_score"),
        _ratio("time", "timed").alias("average_execution_time"),
        _ratio("errors", "n").alias("error_rate"),
    ).where("total_samples > 0")


def pass_summary_of_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """``pass_summary`` from cells."""
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("total_samples"),
        F.sum("correct").alias("passed"),
        (F.sum("n") - F.sum("correct")).alias("failed"),
        _ratio("correct", "n").alias("success_rate"),
        _ratio("score", "scored").alias("average_score"),
    )


def error_rates(results: DataFrame) -> DataFrame:
    """Errors and error rate of every evaluation type, also where there are none."""
    return results.groupBy("evaluation_type").agg(
        F.count("error_message").alias("total_errors"),
        _share(F.count("error_message")).alias("error_rate"),
    )


def error_patterns(results: DataFrame) -> DataFrame:
    """Every error message per type and difficulty, with how often it occurred."""
    return (
        results.where(F.col("error_message").isNotNull())
        .groupBy("evaluation_type", "difficulty", "error_message")
        .agg(F.count("*").alias("occurrences"))
    )


def top_error_patterns(results: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent messages per type and difficulty."""
    rank = F.row_number().over(
        W.partitionBy("evaluation_type", "difficulty").orderBy(F.desc("occurrences"), "error_message")
    )
    return error_patterns(results).withColumn("rank", rank).where(F.col("rank") <= k)


def pass_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Total, passed and failed samples with the success rate, overall or per key."""
    grouped = results.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("total_samples"),
        F.count_if("is_correct").alias("passed"),
        (F.count("*") - F.count_if("is_correct")).alias("failed"),
        _share(F.count_if("is_correct")).alias("success_rate"),
        _rounded(mean("score")).alias("average_score"),
    )


def family_pass_summary(results: DataFrame) -> DataFrame:
    """One row: the overall summary plus the success rate of each family (0 if absent)."""

    def rate(family: str) -> Column:
        of = F.col("evaluation_type") == family
        return _rounded(
            F.coalesce(F.try_divide(F.count_if(of & F.col("is_correct")), F.count_if(of)), F.lit(0.0))
        )

    return results.agg(
        F.count("*").alias("total_samples"),
        F.count_if("is_correct").alias("passed"),
        (F.count("*") - F.count_if("is_correct")).alias("failed"),
        _share(F.count_if("is_correct")).alias("success_rate"),
        rate("sql").alias("sql_success_rate"),
        rate("function").alias("function_success_rate"),
    )


def compare_runs(results: DataFrame, baseline: str, improved: str) -> DataFrame:
    """Both runs side by side with the changes, from one scan over the two runs."""
    both = results.where(F.col("run_id").isin(baseline, improved))

    def of(run: str, value: Column) -> Column:
        return F.when(F.col("run_id") == run, value)

    sides = {"baseline": baseline, "improved": improved}
    sums = both.agg(
        *[F.count_if(F.col("run_id") == r).alias(f"{s}_total") for s, r in sides.items()],
        *[
            F.count_if((F.col("run_id") == r) & F.col("is_correct")).alias(f"{s}_passed")
            for s, r in sides.items()
        ],
        *[mean(of(r, F.col("score"))).alias(f"{s}_score") for s, r in sides.items()],
    )

    def rate(side: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{side}_passed"), F.col(f"{side}_total")), F.lit(0.0))

    return sums.select(
        "baseline_total",
        "improved_total",
        "baseline_passed",
        "improved_passed",
        _rounded(rate("baseline")).alias("baseline_success_rate"),
        _rounded(rate("improved")).alias("improved_success_rate"),
        _rounded(rate("improved") - rate("baseline")).alias("success_rate_change"),
        _rounded(F.col("baseline_score")).alias("baseline_average_score"),
        _rounded(F.col("improved_score")).alias("improved_average_score"),
        _rounded(F.col("improved_score") - F.col("baseline_score")).alias("average_score_change"),
        (F.col("improved_passed") - F.col("baseline_passed")).alias("passed_change"),
    )


def token_usage(responses: DataFrame, *keys: str) -> DataFrame:
    """Token totals, per model or whatever the keys are."""
    return responses.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


COMPONENTS = ("selection", "parameters", "execution", "result")


def with_components(results: DataFrame) -> DataFrame:
    """Component scores of stored results, read from their validation details."""
    details = F.from_json("validation_details", ", ".join(f"{c} double" for c in COMPONENTS))
    return results.withColumn("_d", details).select("*", *[f"_d.{c}" for c in COMPONENTS]).drop("_d")


def component_means(scores: DataFrame, *keys: str, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Mean of each component score, per run, model or whatever the keys are."""
    return scores.groupBy(*keys).agg(
        F.count("*").alias("total_samples"),
        *[_rounded(mean(c)).alias(f"mean_{c}") for c in components],
    )


def model_comparison(results: DataFrame) -> DataFrame:
    """Models ranked by accuracy on the samples that every model answered.

    Results are reduced to one row per (sample, model) before anything is regrouped, so
    a sample with very many attempts shrinks to one row per model.
    """
    per_pair = results.groupBy("sample_id", "model").agg(
        F.count("*").alias("n"),
        F.count_if("is_correct").alias("correct"),
        F.sum(F.col("score").cast(MEAN_TYPE)).alias("score"),
    )
    models = results.agg(F.count_distinct("model").alias("n")).select("n").scalar()
    answered_by = F.count("*").over(W.partitionBy("sample_id"))
    per_model = (
        per_pair.withColumn("answered_by", answered_by)
        .where(F.col("answered_by") == models)
        .groupBy("model")
        .agg(
            F.count("*").alias("common_samples"),
            F.sum("n").alias("total_samples"),
            F.sum("correct").alias("correct_samples"),
            (F.sum("correct") / F.sum("n")).alias("_accuracy"),
            _rounded(F.sum("score").cast("double") / F.sum("n")).alias("average_score"),
        )
    )
    # One row per model is left here.
    ranked = F.rank().over(W.orderBy(F.desc("_accuracy")))
    return per_model.select(
        "model",
        "common_samples",
        "total_samples",
        "correct_samples",
        _rounded(F.col("_accuracy")).alias("accuracy"),
        "average_score",
        ranked.alias("rank"),
    )


def of_evaluation_type(results: DataFrame, evaluation_type: str) -> DataFrame:
    """Rows of the families that an evaluation type covers."""
    if evaluation_type not in EVALUATION_TYPES:
        raise ValueError(f"unknown evaluation type: {evaluation_type}")
    return results.where(F.col("evaluation_type").isin(*EVALUATION_TYPES[evaluation_type]))
