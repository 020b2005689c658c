"""What each predicted call returns: an interval join of calls with the fact rows.

A call asks for a key and a span of years. Facts lie in bins of ``width`` years; a span is cut
into the bins that its key has facts for, so that calls and facts meet by equality on key and bin, and the
years decide inside a bin. A fact lies in one bin, so each pair is met once, and a span of all years is as
many rows as its key has bins. A bin with more than ``hot`` facts is dealt over several parts, and a
call visits each of them. Calls that many answers make are a skewed join side, which adaptive
execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.call_text import argument_or_default
from tallywright.operators.call_execution import ALL_INDUSTRIES, call_request
from tallywright.operators.economics import LINE_CODES
from tallywright.session import stored

WIDTH = 4
HOT = 1 << 16
FACT_KEY = ["domain", "key", "measure"]
#: Measures of series and industries have no code of their own.
ONLY = ""
DEFAULT_LINE = "SA1-1"


def fact_points(
    time_series: DataFrame, industry_gdp: DataFrame, regional: DataFrame, value: str = "numeric_value"
) -> DataFrame:
    """All facts in one form: ``domain, key, measure, year, period, value``.

    An industry's facts stand under its own name and under that of all industries; a state's facts
    stand under one line code per measure.
    """
    none = F.lit(None).cast("int")

    def form(df: DataFrame, domain: str, key: Column, measure: Column, period: Column, amount: Column) -> DataFrame:
        return df.select(
            F.lit(domain).alias("domain"),
            key.alias("key"),
            measure.alias("measure"),
            F.col("year").cast("int").alias("year"),
            period.cast("int").alias("period"),
            amount.cast("double").alias("value"),
        )

    lines = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(m).cast("double").alias("value")) for c, m in LINE_CODES.items()]))
    by_line = regional.select("state_name", "year", lines.alias("line"))
    names = industry_gdp.select("*", F.explode(F.array("industry_name", F.lit(ALL_INDUSTRIES))).alias("_name"))
    parts = [
        form(time_series, "series", F.col("series_id"), F.lit(ONLY), F.col("period_value"), F.col(value)),
        form(names, "industry", F.col("_name"), F.lit(ONLY), none, F.col("gdp_value")),
        form(by_line, "state", F.col("state_name"), F.col("line.code"), none, F.col("line.value")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _measure(call: Column) -> Column:
    """The line code a call for a state asks for; unknown codes mean the default one."""
    code = argument_or_default(call["name"], call["args"], "line_code")
    known = F.when(code.isin(*LINE_CODES), code).otherwise(DEFAULT_LINE)
    return F.when(call["name"] == "get_regional_income", known).otherwise(ONLY)


def asked_spans(df: DataFrame, ids: list[str], predicted: str = "predicted") -> DataFrame:
    """One row per call that can be run: ``ids, call_pos, function_name, domain, key, measure, low, high``."""
    calls = F.transform(F.col(predicted), lambda c: F.struct(c["name"].alias("name"), call_request(c).alias("r"), _measure(c).alias("m")))
    each = df.select(*ids, F.posexplode(calls).alias("call_pos", "_c")).where("_c.r.ok AND _c.r.low <= _c.r.high")
    return each.select(
        *ids,
        "call_pos",
        F.col("_c.name").alias("function_name"),
        F.col("_c.r.domain").alias("domain"),
        F.col("_c.r.key").alias("key"),
        F.col("_c.m").alias("measure"),
        F.col("_c.r.low").alias("low"),
        F.col("_c.r.high").alias("high"),
    )


def returned_rows(spans: DataFrame, points: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Every fact of every call: the columns of ``spans`` but its bounds, and ``year, period, value``.

    Facts with a null key or year answer no call. A call without facts gives no row; repeated calls and
    repeated facts count each.
    """
    facts = points.where(F.col("year").isNotNull()).withColumn("_bin", F.floor(F.col("year") / width).cast("int"))
    bins = facts.groupBy(*FACT_KEY, "_bin").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("_parts"))
    bins = stored(bins, "bins")
    reach = bins.groupBy(*FACT_KEY).agg(F.min("_bin").alias("_first"), F.max("_bin").alias("_last"))
    first = F.greatest(F.floor(F.col("low") / width).cast("int"), F.col("_first"))
    last = F.least(F.floor(F.col("high") / width).cast("int"), F.col("_last"))
    wanted = spans.join(reach, FACT_KEY).withColumns({"_from": first, "_to": last}).where("_from <= _to")
    cut = wanted.withColumn("_bin", F.explode(F.sequence("_from", "_to"))).drop("_first", "_last", "_from", "_to")
    visits = cut.join(bins, [*FACT_KEY, "_bin"])
    visits = visits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    large = bins.where("_parts > 1")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("year", "period", "value"), F.col("_parts"))).cast("int")
    dealt = facts.join(large, [*FACT_KEY, "_bin"], "left").withColumn("_part", part).drop("_parts")
    met = visits.join(dealt, [*FACT_KEY, "_bin", "_part"]).where(F.col("year").between(F.col("low"), F.col("high")))
    return met.drop("_bin", "_part", "low", "high")
