"""Prompt tables: schema text for chosen tables, and message lists per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.call_text import FUNCTION_DEFAULTS, REQUIRED_KEYS
from tallywright.functions.questions import classify_question, classify_question_extended
from tallywright.functions.text import ordered_lookup
from tallywright.sources.fact_tables import FACT_COLUMNS

# First and last year with data, and the text standing in for no context.
FIRST_YEAR, LAST_YEAR = 2014, 2024
NO_CONTEXT = "No additional context provided"
PART_BREAK = "\n---\n"
DEFAULT_TABLE = "budget_outlays"
YEAR_RULE = f"Data covers the years {FIRST_YEAR} to {LAST_YEAR} only; say so when asked for other years."

SYSTEM_TEXT = {
    "sql": "Answer the question with one SQL query over the tables described in its context. Put the query in a code block.",
    "schema_sql": f"Answer the question with one SQL query over the tables listed. {YEAR_RULE} Return the query only.",
    "targeted_sql": "Answer the question with one SQL query over the tables listed. Return the query only.",
    "function": 'Choose the functions that answer the question. Return JSON: {"name": ..., "arguments": {...}}. ' + YEAR_RULE,
    "labelled_function": (
        "Choose functions from the catalogue. Write every call as two lines, the first with the function, the second with "
        "its arguments, and nothing else:\nFunction: name\nParameters: key=value, key=value\n" + YEAR_RULE
    ),
    "catalogue_function": 'Choose functions from the catalogue. Return JSON: {"function_name": ..., "parameters": {...}}.',
}


# What each table holds, and by which columns a sample query sums it up.
HOLDS = {
    "budget_outlays": "federal spending per budget function and fiscal year",
    "time_series_data": "indicator values of the statistics bureaus, per series and period",
    "industry_gdp": "an industry's share of output, per year",
    "regional_data": "income and population of each state, per year",
    "gdp_by_industry": "an industry's contribution to output, per quarter",
    "economic_indicators": "the catalogue of indicators with their sources",
}
SAMPLE_COLUMNS = {
    "budget_outlays": ("function_name", "outlay_amount", "fiscal_year"),
    "time_series_data": ("series_id", "numeric_value", "year"),
    "industry_gdp": ("industry_name", "gdp_value", "year"),
    "regional_data": ("state_name", "personal_income", "year"),
    "gdp_by_industry": ("industry_name", "gdp_contribution", "year"),
}
# The categories that questions name.
KEY_CATEGORIES = {"time_series_data": ["consumer_price_index", "employment_cost_index", "productivity_measures"]}


def sample_query(table: str) -> str:
    """The largest groups of a table in the year before its last, or the sources of a catalogue."""
    if table not in SAMPLE_COLUMNS:
        return f"SELECT source, COUNT(*) AS n FROM {table} GROUP BY source"
    group, amount, year = SAMPLE_COLUMNS[table]
    return f"SELECT {group}, SUM({amount}) AS amount FROM {table} WHERE {year} = {LAST_YEAR - 1} GROUP BY {group} ORDER BY amount DESC LIMIT 5"


def schema_of(table: str) -> str:
    lines = [f"TABLE: {table}", f"HOLDS: {HOLDS[table]}", f"COLUMNS: {', '.join(FACT_COLUMNS[table])}"]
    if table in KEY_CATEGORIES:
        lines.append(f"CATEGORIES: {', '.join(KEY_CATEGORIES[table])}")
    return "\n".join([*lines, f"SAMPLE: {sample_query(table)}"])


def schema_text(tables: Column) -> Column:
    """Schema text of the known tables in a list, in list order; the budget table if there are none."""
    texts = {t: F.lit(schema_of(t)) for t in FACT_COLUMNS}
    parts = F.filter(
        F.transform(tables, lambda t: ordered_lookup(t, texts, F.lit(None).cast("string"))),
        lambda s: s.isNotNull(),
    )

    def render(p: Column) -> Column:
        header = F.concat(
            F.lit("RELEVANT TABLES FOR YOUR QUERY ("), F.size(p).cast("string"), F.lit(" tables):\n\n")
        )
        return (
            F.when(F.size(p) > 1, F.concat(header, F.array_join(p, PART_BREAK)))
            .when(F.size(p) == 1, p[0])
            .otherwise(schema_of(DEFAULT_TABLE))
        )

    return F.transform(F.array(parts), render)[0]


def messages(system: Column, user: Column, context: Column | None = None) -> Column:
    """System and user message; a non-empty context is put before the user's text."""
    if context is not None:
        wrapped = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuery:\n"), user)
        user = F.when(F.length(context) > 0, wrapped).otherwise(user)
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def function_list(functions: Column) -> Column:
    """One ``- name: description`` line per available function."""
    return F.array_join(
        F.transform(
            functions,
            lambda f: F.concat(
                F.lit("- "),
                F.coalesce(f["name"], F.lit("unknown")),
                F.lit(": "),
                F.coalesce(f["description"], F.lit("No description")),
            ),
        ),
        "\n",
    )


def _question(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question)


def _context(context: Column) -> Column:
    given = F.when(F.length(context) > 0, context).otherwise(NO_CONTEXT)
    return F.concat(F.lit("\n\nContext: "), given)


def sql_prompt(question: Column, context: Column) -> Column:
    return messages(F.lit(SYSTEM_TEXT["sql"]), F.concat(_question(question), _context(context)))


def schema_sql_prompt(question: Column, schema: Column, kind: str = "schema_sql") -> Column:
    """Prompt with schema text; ``kind`` is ``schema_sql`` or ``targeted_sql``."""
    user = F.concat(_question(question), F.lit("\n\nDatabase Schema:\n"), schema)
    return messages(F.lit(SYSTEM_TEXT[kind]), user)


def function_prompt(question: Column, functions: Column, context: Column) -> Column:
    user = F.concat(
        _question(question),
        F.lit("\n\nAvailable Functions:\n"),
        function_list(functions),
        _context(context),
    )
    return messages(F.lit(SYSTEM_TEXT["function"]), user)


def catalogue_prompt(question: Column, catalogue: str, kind: str = "catalogue_function") -> Column:
    """Prompt with a catalogue; ``kind`` names the form that the scorer's extraction reads."""
    system = SYSTEM_TEXT[kind] + "\n\n" + catalogue
    return messages(F.lit(system), _question(question))


def catalogue_text(names: list[str]) -> str:
    """One line per function: required keys, and the defaults of the others."""
    lines = []
    for name in names:
        required = REQUIRED_KEYS.get(name, [])
        optional = [f"{k}={v}" for k, v in FUNCTION_DEFAULTS.get(name, {}).items() if k not in required]
        lines.append(f"{name}({', '.join([*required, *optional])})")
    return "\n".join(lines)


def prompt_table(samples: DataFrame, evaluation: str) -> DataFrame:
    """Samples with the messages of one evaluation, one row per sample, for a batch inference job."""
    question = F.col("question")
    context = F.col("context") if "context" in samples.columns else F.lit(None).cast("string")
    if evaluation == "sql_basic":
        prompt = sql_prompt(question, context)
    elif evaluation == "sql":
        prompt = schema_sql_prompt(question, schema_text(classify_question(question)))
    elif evaluation == "sql_targeted":
        schema = schema_text(classify_question_extended(question))
        prompt = schema_sql_prompt(question, schema, "targeted_sql")
    elif evaluation == "calls_matching":
        prompt = function_prompt(question, F.col("available_functions"), context)
    elif evaluation == "calls_catalogue":
        prompt = catalogue_prompt(question, catalogue_text(list(REQUIRED_KEYS)))
    elif evaluation == "calls_executed":
        prompt = catalogue_prompt(question, catalogue_text(list(FUNCTION_DEFAULTS)), "labelled_function")
    else:
        raise ValueError(f"no prompt for evaluation: {evaluation}")
    return samples.select("sample_id", prompt.alias("messages"))
