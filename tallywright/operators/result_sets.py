"""Comparison of result sets stored as long tables.

Both sides are rows of ``(keys..., row_key[, pos])``; ``keys`` name one result set,
such as (run, model, sample). Each comparison is one union and two aggregations: the
first groups by set *and* row, so a set holding a large share of all rows is spread
over many tasks, and the second sees one partial row per set and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pass marks and weights of the two-part verdict.
EXECUTION_PASS = 0.8
RESULT_PASS = 0.9
EXECUTION_WEIGHT, RESULT_WEIGHT = 0.4, 0.6

ROUND_DIGITS = 6


def printed(value: Column, dtype: str, digits: int | None = ROUND_DIGITS) -> Column:
    """A value's text, with NULL as ``None`` and floating point rounded to a fixed scale."""
    if dtype == "boolean":
        value = value.cast("int")
    elif dtype in ("double", "float") or dtype.startswith("decimal"):
        value = value.cast("double")
        if digits is not None:
            value = F.round(value, digits)
    return F.coalesce(value.cast("string"), F.lit("None"))


def unordered_row_key(df: DataFrame, columns: list[str], digits: int | None = ROUND_DIGITS) -> Column:
    """Row identity that ignores column names and order: the sorted texts of the values."""
    types = dict(df.dtypes)
    return F.sort_array(F.array(*[printed(F.col(f"`{c}`"), types[c], digits) for c in columns]))


def ordered_row_key(df: DataFrame, columns: list[str], digits: int | None = ROUND_DIGITS) -> Column:
    """Row identity that keeps column order and tells text from numbers; 1 equals 1.0."""
    types = dict(df.dtypes)

    def one(name: str) -> Column:
        dtype, value = types[name], F.col(f"`{name}`")
        if dtype in ("tinyint", "smallint", "int", "bigint", "boolean"):
            text = F.concat(F.lit("n:"), value.cast("bigint").cast("string"))
        elif dtype in ("double", "float") or dtype.startswith("decimal"):
            number = value.cast("double")
            if digits is not None:
                number = F.round(number, digits)
            whole = (number == F.floor(number)) & (F.abs(number) < 2.0**53)
            text = F.concat(
                F.lit("n:"),
                F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")),
            )
        else:
            text = F.concat(F.lit("s:"), value.cast("string"))
        return F.coalesce(text, F.lit("null"))

    return F.array(*[one(c) for c in columns])


def _two_sides(candidate: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    c = candidate.select(*columns, F.lit(1).alias("c"), F.lit(0).alias("e"))
    e = expected.select(*columns, F.lit(0).alias("c"), F.lit(1).alias("e"))
    return c.unionByName(e)


def result_similarity(candidate: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows two result sets have in common, ignoring order: 2*common/(n1+n2).

    For sorted row lists this equals the longest-block matching ratio. A set present on
    one side only scores 0; sets empty on both sides are not in either table and are
    filled in by ``sql_verdict``.
    """
    per_row = (
        _two_sides(candidate, expected, [*keys, "row_key"])
        .groupBy(*keys, "row_key")
        .agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    )
    return (
        per_row.groupBy(*keys)
        .agg(
            F.sum("c").alias("candidate_rows"),
            F.sum("e").alias("expected_rows"),
            F.sum(F.least("c", "e")).alias("common_rows"),
        )
        .withColumn(
            "similarity",
            2.0 * F.col("common_rows") / (F.col("candidate_rows") + F.col("expected_rows")),
        )
    )


def ordered_equality(candidate: DataFrame, expected: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Whether two result sets hold the same rows in the same order."""
    per_row = (
        _two_sides(candidate, expected, [*keys, pos, "row_key"])
        .groupBy(*keys, pos, "row_key")
        .agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    )
    # A position holds at most one row per side, so equal rows are the groups seen by both.
    return per_row.groupBy(*keys).agg(
        F.sum("c").alias("candidate_rows"),
        F.sum("e").alias("expected_rows"),
        F.bool_and((F.col("c") == 1) & (F.col("e") == 1)).alias("is_equal"),
    )


def passes_result(similarity: Column, error: Column | None = None) -> Column:
    """Result gate: similar enough; a failed comparison scores 0 and does not pass."""
    ok = F.coalesce(similarity, F.lit(0.0)) >= RESULT_PASS
    return ok if error is None else ok & error.isNull()


def sql_verdict(executed: Column, expects_rows: Column, similarity: Column) -> dict[str, Column]:
    """Two-part verdict: did it run, and did it return what was expected.

    Without expected rows anything that ran counts as right. A set that returned nothing
    while rows were expected has no similarity row and scores 0.
    """
    ran = F.coalesce(executed, F.lit(False))
    execution = ran.cast("double")
    result = F.when(~ran, 0.0).when(~expects_rows, 1.0).otherwise(F.coalesce(similarity, F.lit(0.0)))
    return {
        "execution_score": execution,
        "result_score": result,
        "is_correct": (execution >= EXECUTION_PASS) & (result >= RESULT_PASS),
        "score": EXECUTION_WEIGHT * execution + RESULT_WEIGHT * result,
    }


def database_verdict(
    has_sql: Column, executed: Column, has_reference: Column, reference_executed: Column, is_equal: Column
) -> Column:
    """Plain verdict: no statement or a failed one is wrong; without a reference running is enough.

    ``is_equal`` is NULL when both results are empty, which counts as equal.
    """
    return (
        F.when(~has_sql | ~F.coalesce(executed, F.lit(False)), False)
        .when(~has_reference, True)
        .when(~F.coalesce(reference_executed, F.lit(False)), False)
        .otherwise(F.coalesce(is_equal, F.lit(True)))
    )
