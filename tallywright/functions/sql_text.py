"""Pull a SQL statement out of an answer, clean it and label it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import SPACE, contains_any, lines, non_empty, once, strip

# Statement words of the two extraction rules, and the table-name audit.
BASIC_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
BLOCK_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"]
RIGHT_TABLE = "budget_outlays"
WRONG_TABLES = ["government_spending", "budget_data"]

SQL_FENCE = r"(?is)```sql(.*?)```"
ANY_FENCE = r"(?s)```(.*?)```"
# Line breaks are \n alone (d); the text before a statement on its line may be blank.
LINE_START = r"(?dmi)^[^\S\n]*((?:%s)%s)"


def _line_start(keywords: list[str], tail: str) -> str:
    return LINE_START % ("|".join(keywords), tail)


def extract_sql_basic(response: Column) -> Column:
    """First closed sql fence, else first fence holding a statement word, else first statement line.

    An empty sql fence counts as "no statement" and gives NULL, without looking further.
    """
    fenced = strip(F.regexp_extract(response, ANY_FENCE, 1))
    line = F.regexp_extract(response, _line_start(BASIC_KEYWORDS, r"[^\n]*"), 1)
    found = (
        F.when(response.rlike(SQL_FENCE), F.regexp_extract(response, SQL_FENCE, 1))
        .when(contains_any(F.upper(fenced), BASIC_KEYWORDS), fenced)
        .otherwise(line)
    )
    return non_empty(strip(found))


def _without_semicolons(text: Column) -> Column:
    return strip(F.rtrim(strip(text), F.lit(";")))


def _statement_lines(response: Column, first_line_semicolon: bool) -> Column:
    """From the first statement line up to a blank line, or through a line with a semicolon."""
    tail = F.regexp_extract(response, _line_start(BLOCK_KEYWORDS, r"[\s\S]*"), 1)
    first = 0 if first_line_semicolon else 1

    def keep_count(parts: Column) -> Column:
        stops = F.transform(
            parts,
            lambda line, i: F.when(line == "", i).when(
                (i >= first) & line.contains(";"), i + 1
            ),
        )
        return F.coalesce(F.array_min(stops), F.size(parts))

    joined = once(
        F.transform(lines(tail), strip),
        lambda parts: F.array_join(F.slice(parts, F.lit(1), keep_count(parts)), " "),
    )
    return non_empty(strip(F.rtrim(joined, F.lit(";"))))


def extract_sql_block(
    response: Column, first_line_semicolon: bool = False, ci_fence: bool = False
) -> Column:
    """First fenced block (closed or not) or the whole text, if a statement word occurs in it.

    Otherwise the statement's lines are gathered from the text; there
    ``first_line_semicolon`` lets a semicolon on the first line end the statement.
    ``ci_fence`` also accepts an upper-case fence label.
    """
    text = strip(response)
    if ci_fence:
        text = F.regexp_replace(text, r"(?i)```sql", "```sql")
    block = (
        F.when(text.contains("```sql"), F.split_part(F.split_part(text, F.lit("```sql"), F.lit(2)), F.lit("```"), F.lit(1)))
        .when(text.contains("```"), F.split_part(text, F.lit("```"), F.lit(2)))
        .otherwise(text)
    )
    accepted = once(
        _without_semicolons(block),
        lambda b: F.when(once(F.upper(b), lambda u: contains_any(u, BLOCK_KEYWORDS)), b),
    )
    return F.coalesce(accepted, _statement_lines(response, first_line_semicolon))


def clean_sql(sql: Column) -> Column:
    """Drop fences and comments, fold whitespace; literals are not protected."""
    out = F.regexp_replace(sql, rf"(?i)```sql{SPACE}*", "")
    out = F.regexp_replace(out, rf"```{SPACE}*", "")
    out = F.regexp_replace(out, r"--[^\n]*", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    return strip(F.regexp_replace(out, rf"{SPACE}+", " "))


def statement_kind(sql: Column) -> Column:
    """``rows`` for a statement that starts with SELECT, ``affected`` for any other."""
    return F.when(F.upper(strip(sql)).startswith("SELECT"), "rows").when(
        sql.isNotNull(), "affected"
    )


def table_audit(sql: Column) -> Column:
    """Which of the known right and wrong table names the statement mentions."""
    wrong = sql.contains(WRONG_TABLES[0]) | sql.contains(WRONG_TABLES[1])
    return F.when(sql.contains(RIGHT_TABLE), "right").when(wrong, "wrong").when(
        sql.isNotNull(), "none"
    )
