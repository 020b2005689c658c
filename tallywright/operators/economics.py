"""Data-access functions, query shapes and analytic functions over the fact tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions.call_text import FUNCTION_DEFAULTS
from tallywright.operators.call_execution import ALL_INDUSTRIES
from tallywright.session import stored

DIGITS = 6
FIRST_YEAR = 2014
ANY_YEAR = (0, 9999)
_CPI = FUNCTION_DEFAULTS["get_cpi_data"]
_ECI = FUNCTION_DEFAULTS["get_employment_cost_index"]
_PRODUCTIVITY = FUNCTION_DEFAULTS["get_productivity_data"]
_GDP = FUNCTION_DEFAULTS["get_gdp_by_industry"]
_INCOME = FUNCTION_DEFAULTS["get_regional_income"]

# Income measures by line code; an unknown code reads personal income.
LINE_CODES = {
    "SA1-1": "personal_income",
    "SA1-2": "population",
    "SA1-3": "per_capita_income",
}


def series_data(time_series: DataFrame, series_id: str, start_year: int, end_year: int) -> DataFrame:
    return time_series.where(
        (F.col("series_id") == series_id) & F.col("year").between(start_year, end_year)
    )


def get_cpi_data(
    time_series: DataFrame,
    series_id: str = _CPI["series_id"],
    start_year: int = _CPI["start_year"],
    end_year: int = _CPI["end_year"],
) -> DataFrame:
    return series_data(time_series, series_id, start_year, end_year)


def get_employment_cost_index(
    time_series: DataFrame,
    series_id: str = _ECI["series_id"],
    start_year: int = _ECI["start_year"],
    end_year: int = _ECI["end_year"],
) -> DataFrame:
    return series_data(time_series, series_id, start_year, end_year)


def get_productivity_data(
    time_series: DataFrame,
    series_id: str = _PRODUCTIVITY["series_id"],
    start_year: int = _PRODUCTIVITY["start_year"],
    end_year: int = _PRODUCTIVITY["end_year"],
) -> DataFrame:
    return series_data(time_series, series_id, start_year, end_year)


def get_gdp_by_industry(
    industry_gdp: DataFrame, year: int = _GDP["year"], industry: str = _GDP["industry"], table_id: str = _GDP["table_id"]
) -> DataFrame:
    """``table_id`` chooses among the service's tables; here there is one, so it is accepted and unused."""
    out = industry_gdp.where(F.col("year") == year)
    return out if industry == ALL_INDUSTRIES else out.where(F.col("industry_name") == industry)


def get_regional_income(
    regional: DataFrame, state: str = _INCOME["state"], year: int = _INCOME["year"], line_code: str = _INCOME["line_code"]
) -> DataFrame:
    measure = LINE_CODES.get(line_code, LINE_CODES["SA1-1"])
    return regional.where((F.col("state_name") == state) & (F.col("year") == year)).select(
        "state_name", "year", F.lit(line_code).alias("line_code"), F.col(measure).cast("double").alias("value")
    )


def get_budget_outlays(
    budget: DataFrame,
    function_name: str | None = None,
    fiscal_year: int | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
) -> DataFrame:
    """Budget rows under any of the four optional conditions."""
    out = budget
    if function_name is not None:
        out = out.where(F.col("function_name") == function_name)
    if fiscal_year is not None:
        out = out.where(F.col("fiscal_year") == fiscal_year)
    if min_amount is not None:
        out = out.where(F.col("outlay_amount") >= min_amount)
    if max_amount is not None:
        out = out.where(F.col("outlay_amount") <= max_amount)
    return out


def money_sum(value: Column) -> Column:
    """Sum in exact decimals, so the result does not depend on the order of rows."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def money_mean(value: Column) -> Column:
    return F.round(money_sum(value) / F.count(value), 4)


# Query shapes


def top_functions(budget: DataFrame, from_year: int, n: int) -> DataFrame:
    return (
        budget.where(F.col("fiscal_year") >= from_year)
        .groupBy("function_name")
        .agg(money_sum(F.col("outlay_amount")).alias("total_outlays"))
        .orderBy(F.desc("total_outlays"), "function_name")
        .limit(n)
    )


def category_values(time_series: DataFrame, category: str, start_year: int, end_year: int) -> DataFrame:
    return (
        time_series.where((F.col("category") == category) & F.col("year").between(start_year, end_year))
        .select("year", "numeric_value")
        .orderBy("year")
    )


def top_of_year(df: DataFrame, year: int, name: str, value: str, n: int) -> DataFrame:
    return df.where(F.col("year") == year).select(name, value).orderBy(F.desc(value), name).limit(n)


def contribution_totals(gdp: DataFrame, year: int) -> DataFrame:
    return (
        gdp.where(F.col("year") == year)
        .groupBy("industry_name")
        .agg(money_sum(F.col("gdp_contribution")).alias("total_contribution"))
        .orderBy(F.desc("total_contribution"))
    )


def indicator_names(indicators: DataFrame, source: str) -> DataFrame:
    return indicators.where(F.col("source") == source).select("indicator_name", "category").distinct()


def outlay_of(budget: DataFrame, function_name: str, fiscal_year: int) -> DataFrame:
    return budget.where(
        (F.col("function_name") == function_name) & (F.col("fiscal_year") == fiscal_year)
    ).select("record_id", "function_name", "fiscal_year", "outlay_amount")


def top_per_year(budget: DataFrame, n: int) -> DataFrame:
    """The largest outlays of each year; a rank filter is cut down before the shuffle."""
    rank = F.row_number().over(
        W.partitionBy("fiscal_year").orderBy(F.desc("outlay_amount"), "record_id")
    )
    return (
        budget.select("fiscal_year", "record_id", "function_name", "outlay_amount")
        .withColumn("rank", rank)
        .where(F.col("rank") <= n)
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


# Analytic functions

AGGREGATIONS = {
    "sum": money_sum,
    "average": money_mean,
    "avg": money_mean,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(c).cast("double"),
}


def _aggregation(name: str):
    if name not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {name}")
    return AGGREGATIONS[name]


def query_economic_data(
    time_series: DataFrame,
    source: str,
    year_range: tuple[int, int],
    indicator_type: str,
    category: str | None = None,
    aggregation: str = "average",
) -> DataFrame:
    """One indicator (by series) of one source, aggregated per year."""
    df = time_series.where(
        (F.col("source") == source)
        & F.col("year").between(*year_range)
        & (F.col("series_id") == indicator_type)
    )
    if category is not None:
        df = df.where(F.col("category") == category)
    return df.groupBy("year").agg(
        F.count("*").alias("data_points"),
        _aggregation(aggregation)(F.col("numeric_value")).alias("value"),
    )


def query_budget_data(
    budget: DataFrame,
    aggregation: str,
    function_name: str | None = None,
    fiscal_year: int | None = None,
    year_range: tuple[int, int] | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
) -> DataFrame:
    df = get_budget_outlays(budget, function_name, fiscal_year, min_amount, max_amount)
    if year_range is not None:
        df = df.where(F.col("fiscal_year").between(*year_range))
    return df.groupBy("function_name", "fiscal_year").agg(
        _aggregation(aggregation)(F.col("outlay_amount")).alias("value")
    )


def yearly_totals(df: DataFrame, category: str, year: str, value: str, period: tuple[int, int], categories: list[str] | None) -> DataFrame:
    """``(category, year, total)``: the small table every trend function works on."""
    out = df.where(F.col(year).between(*period))
    if categories:
        out = out.where(F.col(category).isin(*categories))
    return out.groupBy(F.col(category).alias("category"), F.col(year).alias("year")).agg(
        money_sum(F.col(value)).alias("total")
    )


def growth(totals: DataFrame) -> DataFrame:
    """Growth rate against the previous year with data; one row per category and year comes in."""
    previous = F.lag("total").over(W.partitionBy("category").orderBy("year"))
    return totals.withColumn("growth_rate", F.try_divide(F.col("total"), previous) - 1)


def trend_summary(totals: DataFrame) -> DataFrame:
    """Slope, mean growth, volatility of growth and next-year forecast per category."""
    # Years are counted from the first year with data, which keeps the intercept small.
    x = F.col("year") - FIRST_YEAR
    slope, base = F.regr_slope(F.col("total"), x), F.regr_intercept(F.col("total"), x)
    return growth(totals).groupBy("category").agg(
        F.round(slope, 2).alias("slope"),
        F.round(F.avg("growth_rate"), DIGITS).alias("mean_growth"),
        F.round(F.stddev_samp("growth_rate"), DIGITS).alias("volatility"),
        F.round(base + slope * (F.max("year") + 1 - FIRST_YEAR), 2).alias("forecast"),
    )


def category_correlation(totals: DataFrame, categories: list[str]) -> DataFrame:
    """Correlation of yearly totals for each pair of the listed categories.

    Categories become columns of one row per year, so no rows are paired up.
    """
    wide = totals.groupBy("year").agg(
        *[F.max(F.when(F.col("category") == c, F.col("total"))).alias(f"t{i}") for i, c in enumerate(categories)]
    )
    pairs = [
        F.struct(
            F.lit(a).alias("category1"),
            F.lit(b).alias("category2"),
            F.round(F.corr(f"t{i}", f"t{j}"), DIGITS).alias("correlation"),
        )
        for i, a in enumerate(categories)
        for j, b in enumerate(categories)
        if i < j
    ]
    return wide.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def analyze_trends(
    df: DataFrame,
    analysis_type: str,
    category: str,
    year: str,
    value: str,
    time_period: tuple[int, int],
    categories: list[str],
) -> DataFrame:
    """Trend, forecast, comparison or correlation of the chosen categories over a period."""
    totals = yearly_totals(df, category, year, value, time_period, categories)
    if analysis_type in ("trend", "forecast"):
        keep = ["category", "forecast"] if analysis_type == "forecast" else ["category", "slope", "mean_growth", "volatility"]
        return trend_summary(totals).select(*keep)
    if analysis_type == "comparison":
        return growth(totals).select(
            "category", "year", "total", F.round("growth_rate", DIGITS).alias("growth_rate")
        )
    if analysis_type == "correlation":
        return category_correlation(totals, categories)
    raise ValueError(f"unknown analysis type: {analysis_type}")


COMPARISONS = {
    "absolute": lambda a, b, whole: a - b,
    "relative": lambda a, b, whole: F.try_divide(a - b, b),
    "percentage": lambda a, b, whole: F.try_divide(100.0 * a, whole),
    "ratio": lambda a, b, whole: F.try_divide(a, b),
}


METRICS = ("spending", "growth", "proportion", "efficiency")


def compare_categories(
    df: DataFrame,
    category1: str,
    category2: str,
    category: str,
    year: str,
    value: str,
    time_period: tuple[int, int],
    comparison_type: str,
    metric: str = "spending",
) -> DataFrame:
    """Two categories per year: difference, relative difference, percentage or ratio.

    The metric compared is the yearly total, its growth over the year before, its share
    of all categories, or its efficiency: the total per record. The percentage is that of the first value in the year's whole.
    """
    if comparison_type not in COMPARISONS:
        raise ValueError(f"unknown comparison type: {comparison_type}")
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    amount = F.col(value)

    def of(name: str) -> Column:
        return money_sum(F.when(F.col(category) == name, amount))

    per_year = (
        df.where(F.col(year).between(*time_period))
        .groupBy(F.col(year).alias("year"))
        .agg(
            of(category1).alias("value1"),
            of(category2).alias("value2"),
            money_sum(amount).alias("whole"),
            *[F.count(F.when(F.col(category) == c, amount)).alias(n) for c, n in ((category1, "n1"), (category2, "n2"))],
            F.count(amount).alias("n"),
        )
    )
    if metric == "growth":
        # One row per year is left, so the window is tiny.
        before = W.orderBy("year")
        per_year = per_year.select(
            "year", *[(F.try_divide(F.col(c), F.lag(c).over(before)) - 1).alias(c) for c in ("value1", "value2", "whole")]
        )
    elif metric == "efficiency":
        sizes = {"value1": "n1", "value2": "n2", "whole": "n"}
        per_year = per_year.select("year", *[F.try_divide(F.col(c), F.col(n)).alias(c) for c, n in sizes.items()])
    elif metric == "proportion":
        per_year = per_year.select(
            "year", *[F.try_divide(F.col(c), F.col("whole")).alias(c) for c in ("value1", "value2", "whole")]
        )
    result = COMPARISONS[comparison_type](F.col("value1"), F.col("value2"), F.col("whole"))
    shown = [c if metric == "spending" else F.round(c, DIGITS).alias(c) for c in ("value1", "value2")]
    return per_year.select("year", *shown, F.round(result, DIGITS).alias("result"))


def seasonal_pattern(series: DataFrame) -> DataFrame:
    """Mean of each period relative to the mean of its series."""
    per_period = series.groupBy("series_id", "period_value").agg(
        F.sum("numeric_value").alias("s"), F.count("numeric_value").alias("n")
    )
    whole = W.partitionBy("series_id")
    return per_period.select(
        "series_id",
        "period_value",
        F.round((F.col("s") / F.col("n")) / (F.sum("s").over(whole) / F.sum("n").over(whole)), DIGITS).alias(
            "seasonal_index"
        ),
    )


def anomalies(series: DataFrame, confidence_threshold: float = 0.95) -> DataFrame:
    """Rows further from their series' mean than the threshold's normal quantile allows.

    Mean and deviation are aggregated and stored, so that their true size is known before the join
    is planned and the rows themselves stay in place; a window would put a whole series into one task.
    """
    limit = NormalDist().inv_cdf(0.5 + confidence_threshold / 2)
    stats = series.groupBy("series_id").agg(
        F.avg("numeric_value").alias("_mean"), F.stddev_samp("numeric_value").alias("_sd")
    )
    stats = stored(stats, "series_stats")
    z = F.try_divide(F.col("numeric_value") - F.col("_mean"), F.col("_sd"))
    return (
        series.join(stats, "series_id")
        .withColumn("z_score", z)
        .where(F.abs("z_score") > limit)
        .select("series_id", "record_id", "year", "numeric_value", F.round("z_score", 4).alias("z_score"))
    )


def cyclical_pattern(series: DataFrame, lag: int) -> DataFrame:
    """Correlation of a series' monthly means with themselves ``lag`` months before."""
    monthly = series.groupBy("series_id", (F.col("year") * 12 + F.col("period_value")).alias("month")).agg(
        F.avg("numeric_value").alias("mean")
    )
    before = monthly.select("series_id", (F.col("month") + lag).alias("month"), F.col("mean").alias("earlier"))
    return (
        monthly.join(before, ["series_id", "month"])
        .groupBy("series_id")
        .agg(F.lit(lag).alias("lag"), F.round(F.corr("mean", "earlier"), DIGITS).alias("autocorrelation"))
    )


# Years looked back for each time horizon.
HORIZON_YEARS = {"short_term": 2, "medium_term": 5, "long_term": None}


def within_horizon(series: DataFrame, time_horizon: str) -> DataFrame:
    """The last years of the data, as many as the horizon names; all for the long term."""
    if time_horizon not in HORIZON_YEARS:
        raise ValueError(f"unknown time horizon: {time_horizon}")
    years = HORIZON_YEARS[time_horizon]
    if years is None:
        return series
    last = series.agg(F.max("year").alias("y")).select("y").scalar()
    return series.where(F.col("year") > last - years)


def identify_patterns(
    series: DataFrame,
    pattern_type: str,
    sources: list[str],
    time_horizon: str = "long_term",
    confidence_threshold: float = 0.95,
    lag: int = 12,
) -> DataFrame:
    """Seasonal, anomaly, cyclical, trend or correlation patterns of the series of some sources."""
    df = within_horizon(series.where(F.col("source").isin(*sources)), time_horizon)
    if pattern_type == "seasonal":
        return seasonal_pattern(df)
    if pattern_type == "anomaly":
        return anomalies(df, confidence_threshold)
    if pattern_type == "cyclical":
        return cyclical_pattern(df, lag)
    if pattern_type == "trend":
        return trend_summary(yearly_totals(df, "series_id", "year", "numeric_value", ANY_YEAR, None))
    if pattern_type == "correlation":
        by_source = yearly_totals(df, "source", "year", "numeric_value", ANY_YEAR, sources)
        return category_correlation(by_source, sources)
    raise ValueError(f"unknown pattern type: {pattern_type}")
