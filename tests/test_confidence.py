"""Confidence of patterns against table values and plain rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import confidence as c
from tallywright.operators.economics import compare_categories


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("t", "freedom", "two_sided"),
    # Values of the t table.
    [(1.0, 1, 0.5), (12.706, 1, 0.95), (1.886, 2, 0.8), (2.571, 5, 0.95), (2.228, 10, 0.95), (3.169, 10, 0.99), (2.042, 30, 0.95), (1.96, 4001, 0.95), (0.0, 7, 0.0)],
)
def test_t_confidence(spark, t, freedom, two_sided):
    assert value(spark, c.t_confidence(F.lit(-t), F.lit(freedom))) == pytest.approx(two_sided, abs=3e-4)


def test_normal_and_fisher(spark):
    for z in (0.0, 0.5, 1.96, -3.0):
        assert value(spark, c.normal_confidence(F.lit(z))) == pytest.approx(math.erf(abs(z) / math.sqrt(2)), abs=1e-6)
    assert value(spark, c.correlation_confidence(F.lit(0.5), F.lit(28))) == pytest.approx(math.erf(math.atanh(0.5) * 5 / math.sqrt(2)), abs=1e-6)
    assert value(spark, c.correlation_confidence(F.lit(1.0), F.lit(10))) == pytest.approx(1.0)
    assert value(spark, c.correlation_confidence(F.lit(0.9), F.lit(3))) is None
    assert value(spark, c.slope_confidence(F.lit(0.9), F.lit(2))) is None


@pytest.mark.parametrize(("f", "d1", "d2", "upper"), [(3.098, 3, 20, 0.95), (1.83, 11, 120, 0.945), (4.94, 3, 20, 0.99), (0.0, 3, 20, 0.0)])
def test_variance_confidence(spark, f, d1, d2, upper):
    got = value(spark, c.variance_confidence(F.lit(f * d1), F.lit(float(d2)), F.lit(d1 + 1), F.lit(d1 + 1 + d2)))
    assert got == pytest.approx(upper, abs=0.012)


def series(spark, shape):
    rng = random.Random(6)
    rows = [("s", "BLS", y, m, round(100 + shape(y, m) + rng.gauss(0, 1), 2), i) for y in range(2014, 2022) for m in range(1, 13) for i in range(2)]
    return spark.createDataFrame(rows, "series_id string, source string, year int, period_value int, numeric_value double, record_id int")


def test_patterns_are_kept_by_their_confidence(spark):
    flat, rising = series(spark, lambda y, m: 0), series(spark, lambda y, m: 3 * (y - 2014))
    waves = series(spark, lambda y, m: 10 * math.sin(2 * math.pi * (12 * y + m) / 7))
    seasons = series(spark, lambda y, m: 5 * (m == 12))
    found = lambda df, kind: c.confident_patterns(df, kind, ["BLS"], confidence_threshold=0.999).collect()
    assert found(flat, "trend") == [] and found(flat, "seasonal") == []
    assert len(found(rising, "trend")) == 1
    (best,) = found(waves, "cyclical")
    assert best.lag in (7, 14, 21) and best.autocorrelation > 0.9
    december = {r.period_value: r.seasonal_index for r in found(seasons, "seasonal")}
    assert len(december) == 12 and max(december, key=december.get) == 12
    assert c.confident_patterns(flat.limit(0), "cyclical", ["BLS"]).collect() == []
    with pytest.raises(ValueError, match="confidence"):
        c.confident_patterns(flat, "trend", ["BLS"], confidence_threshold=95)


@pytest.mark.parametrize("n", [1, 5, 150])
def test_pair_correlations_of_many_categories(spark, n):
    rng = np.random.default_rng(n)
    totals = {(f"c{k}", y): float(rng.integers(0, 1000)) for k in range(n) for y in range(2010, 2020) if rng.random() < 0.9}
    df = spark.createDataFrame([(k, y, v) for (k, y), v in totals.items()], "category string, year int, total double")
    got = {(r.category1, r.category2): (r.years, r.correlation) for r in c.pair_correlations(df).collect()}
    names = sorted({k for k, _ in totals})
    assert len(got) == len(names) * (len(names) - 1) // 2
    for a, b in list(got)[:200]:
        both = [(totals[a, y], totals[b, y]) for y in range(2010, 2020) if (a, y) in totals and (b, y) in totals]
        assert got[a, b][0] == len(both)
        assert got[a, b][1] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)


def test_combined_totals_and_chosen_metrics(spark):
    budget = spark.createDataFrame([("defense", 2014, 10.0), ("defense", 2015, 20.0)], "function_name string, fiscal_year int, outlay_amount double")
    facts = spark.createDataFrame([("prices", 2014, 1.0), ("prices", 2015, 3.0), ("prices", 2030, 9.0)], "category string, year int, numeric_value double")
    rows = {(r.category, r.year): r.total for r in c.domain_totals(budget, facts, "combined", (2014, 2015)).collect()}
    assert rows == {("defense", 2014): 10.0, ("defense", 2015): 20.0, ("prices", 2014): 1.0, ("prices", 2015): 3.0}
    assert c.domain_totals(budget, facts, "budget", (2014, 2015), ["none"]).collect() == []
    with pytest.raises(ValueError, match="data type"):
        c.domain_totals(budget, facts, "other", (2014, 2015))
    with pytest.raises(ValueError, match="metrics"):
        c.chosen_metrics(budget, ["colour"])


def test_efficiency_is_the_total_per_record(spark):
    df = spark.createDataFrame([("a", 2014, 10.0), ("a", 2014, 20.0), ("b", 2014, 5.0)], "k string, y int, v double")
    (row,) = compare_categories(df, "a", "b", "k", "y", "v", (2014, 2014), "ratio", "efficiency").collect()
    assert (row.value1, row.value2, row.result) == (15.0, 5.0, 3.0)
