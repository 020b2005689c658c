"""Compare results of distinct statements with expected rows or with other statements.

Results are stored once per statement. A statement given by very many answers is compared
once per distinct (statement, sample) or (statement, reference) pair, and its rows are
never copied per answer: the smaller, authored side drives the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_rows(samples: DataFrame, sample_id: str = "sample_id", expected: str = "expected_result") -> DataFrame:
    """Rows a question expects, keyed like result rows: sorted texts of the values.

    An empty list means nothing is expected, so such samples have no rows here.
    """
    text = lambda v: F.coalesce(
        F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .when(
            F.schema_of_variant(v).startswith("DECIMAL") | (F.schema_of_variant(v) == "DOUBLE"),
            F.round(F.try_variant_get(v, "$", "double"), 6).cast("string"),
        )
        .otherwise(F.try_variant_get(v, "$", "string")),
        F.lit("None"),
    )
    return samples.select(sample_id, F.explode(expected).alias("row")).select(
        sample_id, F.sort_array(F.transform(F.map_values("row"), text)).alias("row_key")
    )


def statement_similarity(pairs: DataFrame, rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Similarity per (sql_id, sample_id) pair; pairs without expected rows are left out.

    Equal rows are counted first on both sides. Common rows come from joining the counts
    of the expected rows with those of the statement, so the work is bounded by pairs
    times expected rows, however many rows a statement returned.
    """
    have = rows.groupBy("sql_id", "row_key").agg(F.count("*").alias("c"))
    want = expected.groupBy("sample_id", "row_key").agg(F.count("*").alias("e"))
    sizes = rows.groupBy("sql_id").agg(F.count("*").alias("candidate_rows"))
    asked = pairs.select("sql_id", "sample_id").distinct().join(want, "sample_id")
    common = (
        asked.join(have, ["sql_id", "row_key"], "left")
        .groupBy("sql_id", "sample_id")
        .agg(
            F.sum("e").alias("expected_rows"),
            F.sum(F.least("e", F.coalesce("c", F.lit(0)))).alias("common_rows"),
        )
    )
    n = F.coalesce("candidate_rows", F.lit(0))
    return common.join(sizes, "sql_id", "left").select(
        "sql_id",
        "sample_id",
        (2.0 * F.col("common_rows") / (n + F.col("expected_rows"))).alias("similarity"),
    )


def _result_classes(rows: DataFrame) -> DataFrame:
    """``(sql_id, n, class_id)``: statements with the same ordered result share a class.

    Results are grouped by row count and two order-sensitive checksums, and then each one
    is compared row by row with the first of its group, so rows are read once per
    statement and never once per pair of statements. A result that only shares the
    checksums keeps a class of its own.
    """
    prints = rows.groupBy("sql_id").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("pos", "ordered_key")).alias("x1"),
        F.bit_xor(F.xxhash64("ordered_key", F.lit(1), "pos")).alias("x2"),
    )
    first = prints.groupBy("n", "x1", "x2").agg(F.min("sql_id").alias("class_id"))
    grouped = prints.join(first, ["n", "x1", "x2"]).select("sql_id", "n", "class_id")
    head = rows.select(
        F.col("sql_id").alias("class_id"), "pos", F.col("ordered_key").alias("head_key")
    )
    same = (
        rows.join(grouped.where(F.col("sql_id") != F.col("class_id")), "sql_id")
        .join(head, ["class_id", "pos"])
        .groupBy("sql_id")
        .agg(F.bool_and(F.col("ordered_key") == F.col("head_key")).alias("same"))
    )
    keep = F.coalesce(F.col("same"), F.lit(True))
    return grouped.join(same, "sql_id", "left").select(
        "sql_id", "n", F.when(keep, F.col("class_id")).otherwise(F.col("sql_id")).alias("class_id")
    )


def statement_equality(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Ordered equality per distinct (sql_id, reference_id) pair of statements that ran.

    Two results are equal if they are in the same class, or if both are empty.
    """
    classes = _result_classes(rows)
    reference = classes.select(
        F.col("sql_id").alias("reference_id"), F.col("class_id").alias("reference_class")
    )
    return (
        pairs.select("sql_id", "reference_id")
        .distinct()
        .join(classes.select("sql_id", "class_id"), "sql_id", "left")
        .join(reference, "reference_id", "left")
        .select(
            "sql_id",
            "reference_id",
            F.col("class_id").eqNullSafe(F.col("reference_class")).alias("is_equal"),
        )
    )
