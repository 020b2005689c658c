"""Call extraction: one case per branch, expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import call_text


def _calls(spark, text, extract):
    df = spark.createDataFrame([(text,)], "t string")
    calls = df.select(extract(F.col("t")).alias("c")).first().c
    return [(c.name, {a.key: (a.kind, a.sval) for a in c.args}) for c in calls]


CPI, ECI, GDP = "get_cpi_data", "get_employment_cost_index", "get_gdp_by_industry"

LABELLED = [
    ("two-line form counts twice", f"Function: {CPI}\nParameters: start_year=2015, end_year='2016'",
     [(CPI, {"start_year": ("int", "2015"), "end_year": ("int", "2016")})] * 2),
    ("one-line form", f"function: {CPI} parameters: a=b", [(CPI, {"a": ("str", "b")})]),
    ("call form counts twice", f"call {GDP}(year=2016)", [(GDP, {"year": ("int", "2016")})] * 2),
    ("bad number cuts the rest", f"{GDP}(year=2019, industry=31-33, table_id=5)", [(GDP, {"year": ("int", "2019")})]),
    ("typed values", f"{CPI}(a=TRUE, b=none, c=-1.50, d=007, e=1.2.3, f=x)",
     [(CPI, {"a": ("bool", "True"), "b": ("null", "None"), "c": ("float", "-1.5"), "d": ("int", "7")})]),
    ("last value of a key", f"{CPI}(a=1, b=2, a=3)", [(CPI, {"b": ("int", "2"), "a": ("int", "3")})]),
    ("unknown function", "other(a=1)", []),
    ("names are case-sensitive when written", f"{CPI.upper()}(a=1)", None),
    ("parentheses do not span lines", f"{CPI}(a=1,\nb=2)", None),
]


@pytest.mark.parametrize("why, text, want", LABELLED, ids=[c[0] for c in LABELLED])
def test_labelled(spark, why, text, want):
    got = _calls(spark, text, call_text.extract_calls_labelled)
    if want is None:
        # Falls back to the mentioned function with its defaults.
        assert [n for n, _ in got] == [CPI] and got[0][1]["start_year"] == ("int", "2020")
    else:
        assert got == want


def test_labelled_mentions_in_catalogue_order(spark):
    got = _calls(spark, f"either {GDP} or {CPI.upper()}", call_text.extract_calls_labelled)
    assert [n for n, _ in got] == [CPI, GDP]
    assert got[1][1] == {"year": ("int", "2023"), "industry": ("str", "ALL"), "table_id": ("str", "1")}


def test_labelled_dedupe(spark):
    text = f"call {GDP}(year=2016) and {GDP}(year=2017)"
    got = _calls(spark, text, lambda c: call_text.extract_calls_labelled(c, dedupe=True))
    assert [a["year"][1] for _, a in got] == ["2016", "2017"]


TIERED = [
    ("flat objects", '{"function_name": "a"} and {"function_name": "b", "x": 1}', [("a", {}), ("b", {})]),
    ("nested object fails the first tier, text is not JSON", 'x {"function_name": "a", "parameters": {"k": 1}}', []),
    ("whole text is a list",
     ' [{"function_name": "a", "parameters": {"k": 1, "f": 1.5, "s": "2", "b": true, "n": null, "l": [1]}}] ',
     [("a", {"k": ("int", "1"), "f": ("float", "1.5"), "s": ("str", "2"), "b": ("bool", "True"),
             "n": ("null", "None"), "l": ("json", "[1]")})]),
    ("whole text is an object", '{"function_name": "a", "parameters": {"k": 1}}', [("a", {"k": ("int", "1")})]),
    ("text after JSON spoils it", '{"function_name": "a", "parameters": {"k": 1}} done', []),
    ("list followed by another", '[{"function_name": "a", "parameters": {}}], []', []),
    ("known functions in text", f'{CPI}(start_year=2015, x="1.5", y=-3, z) other(a=1)',
     [(CPI, {"start_year": ("int", "2015"), "x": ("float", "1.5"), "y": ("str", "-3")})]),
    ("repeated JSON key", '{"function_name": "a", "parameters": {"k": 1, "k": 2}}', [("a", {"k": ("int", "2")})]),
]


@pytest.mark.parametrize("why, text, want", TIERED, ids=[c[0] for c in TIERED])
def test_tiered(spark, why, text, want):
    assert _calls(spark, text, call_text.extract_calls_tiered) == want


def test_tiered_nested(spark):
    text = 'x {"function_name": "a", "parameters": {"k": 1}} y'
    got = _calls(spark, text, lambda c: call_text.extract_calls_tiered(c, nested=True))
    assert got == [("a", {"k": ("int", "1")})]


PLAIN = [
    ("JSON then text", '{"name": "a", "arguments": null} b(x=1, y = "2=3")',
     [("a", {}), ("b", {"x": ("str", "1"), "y": ("str", "2=3")})]),
    ("nested arguments are not seen", '{"name": "a", "arguments": {"k": 1}}', []),
    ("any word counts", "f() g(no pairs)", [("f", {}), ("g", {})]),
    ("broken JSON is skipped", '{"name": "a", "arguments": oops}', []),
]


@pytest.mark.parametrize("why, text, want", PLAIN, ids=[c[0] for c in PLAIN])
def test_json_and_text(spark, why, text, want):
    assert _calls(spark, text, call_text.extract_calls_json_and_text) == want


def test_json_and_text_nested(spark):
    text = '{"name": "a", "arguments": {"k": 1}} {"name": "b", "arguments": null}'
    got = _calls(spark, text, lambda c: call_text.extract_calls_json_and_text(c, nested=True))
    assert got == [("a", {"k": ("int", "1")}), ("b", {})]


def test_words_beyond_ascii(spark):
    assert _calls(spark, "größe(weite\u00a0=\u00a01, b=é)", call_text.extract_calls_json_and_text) == [
        ("größe", {"weite": ("str", "1"), "b": ("str", "é")})
    ]
    got = _calls(spark, f"Function:\u00a0{CPI}\u2003Parameters: größe=1", call_text.extract_calls_labelled)
    assert got == [(CPI, {"größe": ("int", "1")})]


@pytest.mark.parametrize("piece", ["x", "f(", "{", "{x ", '"name"', "a=", "a ", "call ", "Function: a ", "\n"])
def test_long_texts_take_linear_time(spark, piece):
    # A million characters of something that never completes: quadratic matching would take hours.
    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)),)], "t string")
    row = df.select(
        F.size(call_text.extract_calls_json_and_text(F.col("t"))).alias("a"),
        F.size(call_text.extract_calls_tiered(F.col("t"))).alias("b"),
        F.size(call_text.extract_calls_labelled(F.col("t"))).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (0, 0, 0)


@pytest.mark.parametrize(
    "call, ok",
    [
        ('{"name": "get_cpi_data", "arguments": {"start_year": 1, "end_year": null}}', True),
        ('{"name": "get_cpi_data", "arguments": {"start_year": 1}}', False),
        ('{"name": "get_regional_income", "arguments": {"state": "CA", "year": 1}}', True),
        ('{"name": "get_budget_outlays", "arguments": {}}', True),
        ('{"name": "get_productivity_data", "arguments": {"start_year": 1, "end_year": 2}}', False),
    ],
)
def test_well_formed(spark, call, ok):
    df = spark.createDataFrame([(f"[{call}]",)], "t string")
    calls = df.select(call_text.calls_from_json(F.col("t")).alias("c"))
    assert calls.select(call_text.well_formed(F.col("c")[0]).alias("ok")).first().ok is ok
