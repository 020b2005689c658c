"""Dense positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 18


def _same(columns: list[str], side: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_{side}_{c}")) for c in columns]


def _renamed(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{side}_{c}" for c in columns})


def dense_positions(
    df: DataFrame,
    group: list[str],
    order: str,
    ties: list[str] | None = None,
    name: str = "pos",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Number the rows of each group 1..n by a whole-number order column.

    ``row_number()`` over the group would sort a whole group in one task. Groups of more than
    ``range_rows`` rows are cut into ranges of the order, as wide as their own bounds and number of rows ask for; rows are
    numbered inside a range and shifted by the row count of the ranges before. Smaller groups are
    one range. Null keys are a group like any other, and null order values come first.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high")).where(F.col("_n") > range_rows)
    width = F.ceil((F.col("_high") - F.col("_low") + 1) * F.lit(range_rows) / F.col("_n"))
    large = _renamed(sizes.select(*group, "_low", width.alias("_width")), group, "l")
    place = F.coalesce(F.floor((F.col(order) - F.col("_low")) / F.col("_width")), F.lit(-1))
    ranged = df.join(large, _same(group, "l"), "left").withColumn("_range", F.when(F.col("_width").isNull(), 0).otherwise(place))
    # Only the ranges of large groups have others before them; their counts are partial-aggregated.
    keys = [*group, "_range"]
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.where(F.col("_width").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    before = _renamed(before.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), keys, "b")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), *(ties or [])))
    placed = ranged.withColumn("_inside", inside).join(before, _same(keys, "b"), "left")
    return placed.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside")).select(*df.columns, name)


def partition_positions(df: DataFrame, group: list[str], part: str, index: str, name: str = "pos") -> DataFrame:
    """Positions of rows stored with (partition number, index in partition).

    The stored pair is already in result order, so only the partition sizes are summed up.
    """
    before = (
        df.groupBy(*group, part)
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    return (
        df.join(before, [*group, part])
        .withColumn(name, F.col("_before") + F.col(index) + 1)
        .drop("_before")
    )

