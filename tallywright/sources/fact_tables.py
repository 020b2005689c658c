"""Schemas of the economic fact tables and registration of their views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The fact tables and their columns.
FACT_COLUMNS = {
    "budget_outlays": [
        "record_id", "superfunction", "function_name", "fiscal_year",
        "outlay_amount", "unit", "source",
    ],
    "time_series_data": [
        "record_id", "series_id", "indicator_id", "source", "category", "subcategory",
        "year", "period_type", "period_value", "period_name", "fiscal_calendar",
        "geographic_level", "geographic_code", "geographic_name", "raw_value",
        "numeric_value", "unit", "unit_multiplier", "is_estimated", "footnotes",
    ],
    "industry_gdp": [
        "record_id", "industry_code", "industry_name", "year", "gdp_value",
        "unit", "unit_multiplier", "source",
    ],
    "regional_data": [
        "record_id", "state_code", "state_name", "region", "year", "personal_income",
        "per_capita_income", "population", "unit", "source",
    ],
    "gdp_by_industry": [
        "record_id", "industry_code", "industry_name", "year", "quarter",
        "gdp_contribution", "percentage_of_total", "unit", "source",
    ],
    "economic_indicators": [
        "indicator_id", "indicator_name", "category", "source", "update_frequency",
        "description",
    ],
}


def read_facts(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Fact tables stored as Parquet below one folder, one subfolder each."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names or FACT_COLUMNS}


def register_facts(facts: dict[str, DataFrame]) -> None:
    """Make the fact tables visible to candidate statements under their own names."""
    for name, df in facts.items():
        df.createOrReplaceTempView(name)
