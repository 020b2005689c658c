"""Run predicted calls against the fact tables, all calls together.

A call asks for a key (series, industry or state) and a span of years. The facts are
first reduced to one row per key with the years it has data for, and stored. Requests are
joined with that table, broadcast if its size on disk allows, once per distinct list of requests, and the
answers look up what their list found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.call_text import argument_or_default
from tallywright.functions.text import once
from tallywright.session import stored

SERIES_FUNCTIONS = ["get_cpi_data", "get_employment_cost_index", "get_productivity_data"]
ALL_INDUSTRIES = "ALL"


def fact_coverage(time_series: DataFrame, industry_gdp: DataFrame, regional: DataFrame) -> DataFrame:
    """``(domain, key, years)``: the years with data for each series, industry and state."""
    parts = [
        time_series.select(F.lit("series").alias("domain"), F.col("series_id").alias("key"), "year"),
        industry_gdp.select(F.lit("industry").alias("domain"), F.col("industry_name").alias("key"), "year"),
        industry_gdp.select(F.lit("industry").alias("domain"), F.lit(ALL_INDUSTRIES).alias("key"), "year"),
        regional.select(F.lit("state").alias("domain"), F.col("state_name").alias("key"), "year"),
    ]
    # distinct() first: at most one row per key and year reaches collect_list.
    years = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    covered = years.groupBy("domain", "key").agg(F.collect_list("year").alias("years"))
    return stored(covered, "coverage")


def call_request(call: Column) -> Column:
    """What a call asks the facts for; ``ok`` says that it can be run at all."""
    name, args = call["name"], call["args"]

    def text(key: str) -> Column:
        return argument_or_default(name, args, key)

    series = name.isin(*SERIES_FUNCTIONS)
    industry, state = name == "get_gdp_by_industry", name == "get_regional_income"
    asked = F.struct(
        F.when(series, "series").when(industry, "industry").when(state, "state").alias("domain"),
        F.when(series, text("series_id"))
        .when(industry, text("industry"))
        .when(state, text("state"))
        .alias("key"),
        F.when(series, text("start_year")).otherwise(text("year")).try_cast("int").alias("low"),
        F.when(series, text("end_year")).otherwise(text("year")).try_cast("int").alias("high"),
    )
    return once(
        asked,
        lambda r: F.struct(
            *[r[f].alias(f) for f in ("domain", "key", "low", "high")],
            (r["domain"].isNotNull() & r["low"].isNotNull() & r["high"].isNotNull()).alias("ok"),
        ),
    )


def with_requests(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    return df.withColumn("requests", F.transform(F.col(predicted), call_request))


def execution_success(requests: Column) -> Column:
    """Share of predicted calls that name a known function with usable years; 0 without calls."""
    ran = F.size(F.filter(requests, lambda r: r["ok"]))
    return F.when(F.size(requests) == 0, 0.0).otherwise(ran / F.size(requests))


def _share(found: Column, requests: Column) -> Column:
    calls = F.size(requests)
    return F.when(calls == 0, 0.0).otherwise(found / calls)


def _has_data(years: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.exists(years, lambda y: y.between(low, high)), F.lit(False))


def _asked(requests: Column) -> Column:
    """What the requests that can be run ask for."""
    fields = ("domain", "key", "low", "high")
    return F.transform(F.filter(requests, lambda r: r["ok"]), lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def _list_id(asked: Column) -> list[Column]:
    """Identity of a list of requests by its content; NULL without requests."""
    some = F.size(asked) > 0
    return [F.when(some, F.xxhash64(asked)).alias("_x"), F.when(some, F.xxhash64(F.lit(1), asked)).alias("_y")]


def _found_data(asked: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(_x, _y, _found)``: how many requests of each distinct list in ``_asked`` find a fact row, if any does."""
    lists = asked.where(F.size("_asked") > 0).distinct()
    each = lists.select(*_list_id(F.col("_asked")), F.explode("_asked").alias("_r"))
    met = each.join(coverage, (F.col("_r.domain") == F.col("domain")) & (F.col("_r.key") == F.col("key")))
    hits = met.where(_has_data(F.col("years"), F.col("_r.low"), F.col("_r.high")))
    return hits.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_found"))


def result_accuracy(df: DataFrame, coverage: DataFrame) -> DataFrame:
    """Add ``result``: the share of a row's calls that find at least one fact row.

    ``df`` carries ``requests``. It is stored, so that its calls are parsed once. Only the distinct lists of
    requests are put to the facts; the rows then look up the count of their list, and so are not grouped and need
    no keys. They stay where they are if the counts can be broadcast by their size on disk. Rows that ask for
    nothing get a key of their own that matches no count, which spreads them should the join have to shuffle.
    """
    rows = stored(df, "requests")
    found = stored(_found_data(rows.select(_asked(F.col("requests")).alias("_asked")), coverage), "found")
    x, y = _list_id(F.col("_asked"))
    own = F.monotonically_increasing_id()
    keyed = rows.withColumn("_asked", _asked(F.col("requests"))).withColumns({"_x": F.coalesce(x, own), "_y": y})
    share = _share(F.coalesce("_found", F.lit(0)), F.col("requests")).alias("result")
    return keyed.join(found, ["_x", "_y"], "left").select(*[f"`{c}`" for c in df.columns], share)
