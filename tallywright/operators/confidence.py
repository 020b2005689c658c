"""How sure a pattern is: tests of slope, correlation and group means from counts and sums.

Every test is a column expression over sums that merge (counts, exact sums, sums of squares and products), so a
pattern is measured and tested in the one pass that aggregates it. A confidence is 1 less the
probability of so strong a pattern in data without any; it is null where there are too few points to tell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.economics import ANY_YEAR, DIGITS, money_sum, within_horizon, yearly_totals

# A rational approximation of the error function, exact to 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

BLOCK = 64
LEAST_PAIRS = 12
EXACT = "decimal(18,2)"


def normal_confidence(z: Column) -> Column:
    """Probability that a standard normal value is nearer to 0 than ``z``."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    total: Column = F.lit(0.0)
    for a in reversed(ERF_A):
        total = (total + a) * t
    return 1 - total * F.exp(-x * x)


def t_confidence(t: Column, freedom: Column) -> Column:
    """The same for Student's t with a whole number of degrees of freedom, by its finite series.

    With the angle ``atan(t / sqrt(freedom))``, the terms are products of even powers of its cosine; odd and
    even degrees differ in the first term and in the factors.
    """
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = freedom % 2 == 1
    # Factor of step k: 2k / (2k + 1) for odd degrees, (2k - 1) / 2k for even ones.
    steps = F.when(odd, (freedom - 3) / 2).otherwise((freedom - 2) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        factor = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = acc["term"] * factor * cosine * cosine
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ks = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(ks, start, add, lambda acc: acc["sum"])
    rest = F.when(freedom > 1, sine * cosine * series).otherwise(0.0)
    return F.when(freedom >= 1, F.when(odd, (angle + rest) * (2 / math.pi)).otherwise(sine * series))


def correlation_confidence(r: Column, n: Column) -> Column:
    """Fisher's test: the inverse hyperbolic tangent of a correlation is normal with variance 1 / (n - 3)."""
    bounded = F.greatest(F.least(r, F.lit(1 - 1e-12)), F.lit(-1 + 1e-12))
    return F.when(n > 3, normal_confidence(F.atanh(bounded) * F.sqrt(n - 3)))


def slope_confidence(r: Column, n: Column) -> Column:
    """The t test of a slope, from the correlation with the years."""
    t = F.abs(r) * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-12)))
    return t_confidence(t, (n - 2).cast("int"))


def variance_confidence(between: Column, within: Column, groups: Column, n: Column) -> Column:
    """The F test of group means, by the cube-root normal approximation of F (error below 0.01)."""
    d1, d2 = groups - 1, n - groups
    ratio = F.try_divide(between / d1, within / d2)
    root = F.cbrt(ratio)
    a, b = 2 / (9 * d1), 2 / (9 * d2)
    z = ((1 - b) * root - (1 - a)) / F.sqrt(b * root * root + a)
    upper = (1 + F.signum(z) * normal_confidence(z)) / 2
    return F.when((d1 > 0) & (d2 > 0), upper)


def _kept(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("confidence") >= threshold).withColumn("confidence", F.round("confidence", 4))


def confident_trends(totals: DataFrame, threshold: float) -> DataFrame:
    """Slopes of yearly totals that the t test confirms."""
    n, r = F.count("total"), F.corr(F.col("year").cast("double"), F.col("total"))
    tested = totals.groupBy("category").agg(
        F.round(F.regr_slope(F.col("total"), F.col("year") - 2014), 2).alias("slope"), n.alias("years"), slope_confidence(r, n).alias("confidence")
    )
    return _kept(tested, threshold)


def pair_correlations(totals: DataFrame) -> DataFrame:
    """``(category1, category2, years, correlation)`` of all pairs of categories, over their common years.

    Categories are dealt into blocks of about ``BLOCK``; a year's totals of two blocks meet in one group, so the
    work is spread over pairs of blocks and the plan has one size whatever the number of categories.
    """
    blocks = max(1, -(-totals.agg(F.count_distinct("category")).first()[0] // BLOCK))
    block = F.pmod(F.xxhash64("category"), F.lit(blocks)).cast("int")
    rows = totals.where(F.col("total").isNotNull()).select("category", "year", "total", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    key = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    a = rows.select("year", *key, F.col("category").alias("category1"), F.col("total").alias("a"), F.col("own").alias("own1"))
    b = rows.select("year", *key, F.col("category").alias("category2"), F.col("total").alias("b"), F.col("own").alias("own2"))
    # Two categories meet where the group is that of their own two blocks.
    own = (F.least("own1", "own2") == F.col("low")) & (F.greatest("own1", "own2") == F.col("high"))
    met = a.join(b, ["year", "low", "high"]).where((F.col("category1") < F.col("category2")) & own)
    return met.groupBy("category1", "category2").agg(F.count(F.lit(1)).alias("years"), F.corr("a", "b").alias("correlation"))


def confident_correlations(totals: DataFrame, threshold: float) -> DataFrame:
    """Pairs of categories whose correlation Fisher's test confirms."""
    pairs = pair_correlations(totals).withColumn("confidence", correlation_confidence(F.col("correlation"), F.col("years")))
    return _kept(pairs, threshold).withColumn("correlation", F.round("correlation", DIGITS))


def confident_seasons(series: DataFrame, threshold: float) -> DataFrame:
    """Seasonal indexes of the series whose period means differ by the F test, from sums per period."""
    value = F.col("numeric_value").cast(EXACT)
    cells = series.groupBy("series_id", "period_value").agg(
        F.sum(value).cast("double").alias("s"), F.count(value).alias("n"), F.sum((value * value).cast("decimal(30,4)")).cast("double").alias("q")
    )
    total = F.sum("s")
    means = F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("n")))
    between, within = means - total * total / F.sum("n"), F.sum("q") - means
    tested = cells.where("n > 0").groupBy("series_id").agg(
        (total / F.sum("n")).alias("mean"), variance_confidence(between, within, F.count(F.lit(1)), F.sum("n")).alias("confidence")
    )
    # One row per series: joined with one row per period.
    index = F.round(F.col("s") / F.col("n") / F.col("mean"), DIGITS).alias("seasonal_index")
    return cells.where("n > 0").join(_kept(tested, threshold), "series_id").select("series_id", "period_value", index, "confidence")


def cycles(series: DataFrame, max_lag: int, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``(series_id, lag, pairs, autocorrelation)`` for all lags up to ``max_lag`` months.

    Monthly means are met with themselves on month and lag: a month is at most ``max_lag`` rows.
    """
    monthly = series.groupBy("series_id", (F.col("year") * 12 + F.col("period_value")).alias("month")).agg(
        (money_sum(F.col("numeric_value")) / F.count("numeric_value")).alias("mean")
    )
    earlier = monthly.select("series_id", F.col("month").alias("from"), F.col("mean").alias("earlier"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    earlier = earlier.select("series_id", (F.col("from") + F.col("lag")).alias("month"), "lag", "earlier")
    met = monthly.join(earlier, ["series_id", "month"]).groupBy("series_id", "lag")
    return met.agg(F.count(F.lit(1)).alias("pairs"), F.corr("mean", "earlier").alias("autocorrelation")).where(F.col("pairs") >= least_pairs)


def confident_cycles(series: DataFrame, max_lag: int, threshold: float, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """The lag of the highest autocorrelation of each series, where Fisher's test confirms it."""
    # Rounded, so that equal correlations are ties; the shortest lag wins.
    rounded = cycles(series, max_lag, least_pairs).withColumn("autocorrelation", F.round("autocorrelation", DIGITS)).where("NOT isnan(autocorrelation)")
    best = rounded.groupBy("series_id").agg(F.max(F.struct("autocorrelation", (-F.col("lag")).alias("lag"), "pairs")).alias("b"))
    found = best.select("series_id", (-F.col("b.lag")).alias("lag"), F.col("b.pairs").alias("pairs"), F.col("b.autocorrelation").alias("autocorrelation"))
    return _kept(found.withColumn("confidence", correlation_confidence(F.col("autocorrelation"), F.col("pairs"))), threshold)


def confident_patterns(
    series: DataFrame,
    pattern_type: str,
    sources: list[str],
    time_horizon: str = "long_term",
    confidence_threshold: float = 0.95,
    max_lag: int = 24,
) -> DataFrame:
    """Trend, correlation, seasonal or cyclical patterns of at least the given confidence."""
    if not 0 <= confidence_threshold <= 1:
        raise ValueError("a confidence lies between 0 and 1")
    df = within_horizon(series.where(F.col("source").isin(*sources)), time_horizon)
    if pattern_type == "trend":
        return confident_trends(yearly_totals(df, "series_id", "year", "numeric_value", ANY_YEAR, None), confidence_threshold)
    if pattern_type == "correlation":
        return confident_correlations(yearly_totals(df, "series_id", "year", "numeric_value", ANY_YEAR, None), confidence_threshold)
    if pattern_type == "seasonal":
        return confident_seasons(df, confidence_threshold)
    if pattern_type == "cyclical":
        return confident_cycles(df, max_lag, confidence_threshold)
    raise ValueError(f"unknown pattern type: {pattern_type}")


DATA_TYPES = ("budget", "economic", "combined")
TREND_METRICS = {"growth_rate": "mean_growth", "volatility": "volatility", "slope": "slope", "forecast": "forecast"}


def domain_totals(budget: DataFrame, time_series: DataFrame, data_type: str, time_period: tuple[int, int], categories: list[str] | None = None) -> DataFrame:
    """Yearly totals of budget functions, of economic categories, or of both in one table."""
    if data_type not in DATA_TYPES:
        raise ValueError(f"unknown data type: {data_type}")
    parts = []
    if data_type != "economic":
        parts.append(yearly_totals(budget, "function_name", "fiscal_year", "outlay_amount", time_period, categories))
    if data_type != "budget":
        parts.append(yearly_totals(time_series, "category", "year", "numeric_value", time_period, categories))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def chosen_metrics(summary: DataFrame, metrics: list[str] | None) -> DataFrame:
    """The asked columns of a trend summary; all without a list."""
    unknown = set(metrics or []) - set(TREND_METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    return summary.select("category", *[TREND_METRICS[m] for m in metrics or TREND_METRICS])
