"""Statement extraction: one case per branch, expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import sql_text

FENCE = "```"
BASIC = {
    "closed sql fence": (f"x {FENCE}sql\n SELECT 1 \n{FENCE} y", "SELECT 1"),
    "upper-case label": (f"{FENCE}SQL\nSELECT 2\n{FENCE}", "SELECT 2"),
    "empty sql fence stops": (f"{FENCE}sql {FENCE}\nSELECT 3", None),
    "unclosed fence, line found": (f"{FENCE}sql\nSELECT 4\nFROM t", "SELECT 4"),
    "generic fence": (f"{FENCE}\nupdate t set a = 1\n{FENCE}", "update t set a = 1"),
    "generic fence without words": (f"{FENCE}\nnothing\n{FENCE}\n  delete from t \nrest", "delete from t"),
    "multi-line cut to a line": ("So:\n\tSELECT a,\n b FROM t", "SELECT a,"),
    "word inside a line": ("I SELECT nothing", None),
    "empty": ("", None),
    "null": (None, None),
}
BLOCK = {
    "sql fence": (f"{FENCE}sql\nSELECT 1;\n{FENCE}", "SELECT 1"),
    "unclosed fence": (f"go {FENCE}sql\nSELECT 2 ;;", "SELECT 2"),
    "second fence ignored": (f"{FENCE}sql SELECT 3{FENCE} {FENCE}sql SELECT 4{FENCE}", "SELECT 3"),
    "upper-case label stays": (f"{FENCE}SQL\nSELECT 5\n{FENCE}", "SQL\nSELECT 5"),
    "prose with a statement word": ("no updates here", "no updates here"),
    "nothing": ("I do not know", None),
    "empty": ("", None),
    "null": (None, None),
    "fence without words, lines": (f"{FENCE}\nhm\n{FENCE}\nSELECT a\n FROM t;\nmore", "SELECT a FROM t"),
    "lines end at a blank": (f"{FENCE}\nhm\n{FENCE}\nalter table t\nadd c\n \nmore", "alter table t add c"),
    "lines run to the end": (f"{FENCE}\nhm\n{FENCE}\nDROP TABLE\nt", "DROP TABLE t"),
    "first line semicolon is passed": (f"{FENCE}\nhm\n{FENCE}\nSELECT 1;\nSELECT 2;\nx", "SELECT 1; SELECT 2"),
}
CLEAN = {
    "comments": ("SELECT a -- x\n, '--' b /* y\nz */ FROM t", "SELECT a , ' z */ FROM t"),
    "block comment": ("SELECT a /* y\nz */ FROM t /* open", "SELECT a FROM t /* open"),
    "fences": (f"{FENCE}SQL  SELECT  1 {FENCE}", "SELECT 1"),
    "whitespace": (" a\t\n b ", "a b"),
}


def _apply(spark, cases, make):
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    return {r.k: r.out for r in df.select("k", make(F.col("t")).alias("out")).collect()}


def test_basic(spark):
    assert _apply(spark, BASIC, sql_text.extract_sql_basic) == {k: v[1] for k, v in BASIC.items()}


def test_block(spark):
    assert _apply(spark, BLOCK, sql_text.extract_sql_block) == {k: v[1] for k, v in BLOCK.items()}


def test_block_first_line_semicolon(spark):
    got = _apply(spark, BLOCK, lambda c: sql_text.extract_sql_block(c, first_line_semicolon=True))
    want = {k: v[1] for k, v in BLOCK.items()} | {"first line semicolon is passed": "SELECT 1"}
    assert got == want


def test_block_any_case_fence(spark):
    got = _apply(spark, BLOCK, lambda c: sql_text.extract_sql_block(c, ci_fence=True))
    assert got["upper-case label stays"] == "SELECT 5"


def test_clean(spark):
    # Line comments go first, also inside literals, and may swallow a block comment's start.
    assert _apply(spark, CLEAN, sql_text.clean_sql) == {k: v[1] for k, v in CLEAN.items()}


@pytest.mark.parametrize(
    "sql, kind, use",
    [
        (" select 1 from budget_outlays", "rows", "right"),
        ("WITH t AS (SELECT 1) SELECT * FROM budget_data", "affected", "wrong"),
        ("DELETE FROM t", "affected", "none"),
        (None, None, None),
    ],
)
def test_kind_and_audit(spark, sql, kind, use):
    df = spark.createDataFrame([(sql,)], "s string")
    row = df.select(sql_text.statement_kind(F.col("s")).alias("k"), sql_text.table_audit(F.col("s")).alias("u")).first()
    assert (row.k, row.u) == (kind, use)


@pytest.mark.parametrize("piece", ["x", " ", "```", "SELECT ", "a\n", "SELECT\n"])
def test_long_texts(spark, piece):
    text = "```sql\n" + piece * (1_000_000 // len(piece)) + "\n```"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        F.length(sql_text.extract_sql_basic(F.col("t"))).alias("a"),
        F.length(sql_text.extract_sql_block(F.col("t"))).alias("b"),
        F.length(sql_text.clean_sql(F.col("t"))).alias("c"),
    ).first()
    assert row.c is not None
