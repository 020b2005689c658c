"""Keyword rules over question text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import contains_any
from tallywright.functions.values import CALLS, literal_arguments

# Keyword groups; each hit names the tables a question is about.
BUDGET_WORDS = [
    "outlays", "spending", "budget", "defense", "military",
    "health", "categories", "functions", "departments", "federal",
]
SERIES_WORDS = [
    "cpi", "consumer price", "inflation", "employment cost",
    "workers", "compensation", "economic indicators", "productivity",
]
SERIES_EXTRA_WORDS = ["time periods", "tracked"]
GDP_WORDS = ["gdp", "industry", "industries", "contribution", "economic sectors"]
REGIONAL_WORDS = ["state", "states", "regional", "personal income", "per capita", "population"]
FALLBACK_BUDGET_WORDS = ["top", "highest", "most", "spending"]
FALLBACK_SERIES_WORDS = ["trend", "change", "growth", "decline"]
DIFFICULTIES = ["easy", "medium", "hard"]


def normal_difficulty(raw: Column) -> Column:
    """Lower-case difficulty; anything unknown or missing is ``medium``."""
    low = F.lower(raw)
    return F.when(low.isin(*DIFFICULTIES), low).otherwise("medium")


def _tables(question: Column, series_words: list[str], fallback) -> Column:
    """Matched tables in fixed order, or the fallback.

    Written without lambdas, so that the lower-cased text and the four tests are each
    computed once per row in generated code.
    """
    low = F.lower(question)
    budget = contains_any(low, BUDGET_WORDS)
    series = contains_any(low, series_words)
    gdp = contains_any(low, GDP_WORDS)
    regional = contains_any(low, REGIONAL_WORDS)
    none = ~(budget | series | gdp | regional)
    picked = F.array(
        F.when(budget, "budget_outlays"),
        F.when(series, "time_series_data"),
        F.when(gdp, "industry_gdp"),
        F.when(gdp, "gdp_by_industry"),
        F.when(regional, "regional_data"),
        F.when(none, fallback(low)),
    )
    return F.array_except(picked, F.array(F.lit(None).cast("string")))


def classify_question(question: Column) -> Column:
    """Tables a question is about; the budget table when nothing matches."""
    return _tables(question, SERIES_WORDS, lambda low: F.lit("budget_outlays"))


def classify_question_extended(question: Column) -> Column:
    """Same with two more series words, and trend words deciding the fallback."""

    def fallback(low: Column) -> Column:
        trend = ~contains_any(low, FALLBACK_BUDGET_WORDS) & contains_any(low, FALLBACK_SERIES_WORDS)
        return F.when(trend, "time_series_data").otherwise("budget_outlays")

    return _tables(question, SERIES_WORDS + SERIES_EXTRA_WORDS, fallback)


# The one call expected for a question, by rule.
EXPECTED_CALLS = {
    "cpi": ("get_cpi_data", {"series_id": "CUUR0000SA0"}),
    "eci": ("get_employment_cost_index", {"series_id": "CIU1010000000000I"}),
    "gdp": ("get_gdp_by_industry", {"year": 2023}),
    "income": ("get_regional_income", {"year": 2023}),
}


def expected_calls(question: Column) -> Column:
    """The call a question asks for, by the first rule that matches."""

    def one(rule: str) -> Column:
        name, args = EXPECTED_CALLS[rule]
        return F.array(
            F.struct(F.lit(name).alias("name"), literal_arguments(args).alias("args"))
        ).cast(CALLS)

    low = F.lower(question)
    return (
        F.when(contains_any(low, ["cpi", "consumer price"]), one("cpi"))
        .when(contains_any(low, ["employment cost", "eci"]), one("eci"))
        .when(low.contains("gdp") & low.contains("industry"), one("gdp"))
        .when(low.contains("income") & contains_any(low, ["state", "region"]), one("income"))
        .otherwise(one("gdp"))
    )


def respects_year_limit(response: Column) -> Column:
    """The answer mentions the last year with data, or says data is not available."""
    return response.contains("2024") | F.lower(response).contains("not available")
