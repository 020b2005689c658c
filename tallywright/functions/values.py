"""Typed argument values and the two rules for matching them.

An argument is ``struct<key, kind, sval, nval, tok>``:

* ``kind`` is int, float, bool, null, str or json (a nested list or object);
* ``sval`` is the value's text as Python's ``str`` prints it;
* ``nval`` is its number, for int, float and bool;
* ``tok`` is equal for two values exactly when Python's ``==`` holds for them,
  so equality of values and of whole argument sets becomes string equality.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import strip

ARG = "struct<key:string,kind:string,sval:string,nval:double,tok:string>"
ARGS = f"array<{ARG}>"
CALLS = f"array<struct<name:string,args:{ARGS}>>"

# Doubles count whole numbers without gaps up to here.
EXACT_INT_LIMIT = 2.0**53

# The two tolerances of the strict and the lenient rule.
STRICT_TOLERANCE = 0.001
LENIENT_TOLERANCE = 0.01
LENIENT_YEAR_GAP = 1

FLOAT_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INT_TEXT = r"^\s*[+-]?\d+\s*$"


def argument(key: Column, kind: Column, sval: Column, nval: Column) -> Column:
    """Assemble one argument, deriving its equality token."""
    token = (
        F.when(nval.isNull(), F.concat(kind, F.lit(":"), sval))
        .when((kind == "int") & (F.abs(nval) >= EXACT_INT_LIMIT), F.concat(F.lit("n:"), sval))
        .otherwise(F.concat(F.lit("n:"), (nval + F.lit(0.0)).cast("string")))
    )
    return F.struct(
        key.alias("key"),
        kind.alias("kind"),
        sval.alias("sval"),
        nval.alias("nval"),
        token.alias("tok"),
    )


def literal_arguments(values: dict[str, object]) -> Column:
    """Fixed arguments (text and whole numbers), as one constant."""

    def one(key: str, value: str | int) -> str:
        if isinstance(value, str):
            rest = f"'str', '{value}', CAST(NULL AS DOUBLE), 'str:{value}'"
        else:
            rest = f"'int', '{value}', {value}D, 'n:{float(value)}'"
        kind, sval, nval, tok = rest.split(", ")
        return f"named_struct('key', '{key}', 'kind', {kind}, 'sval', {sval}, 'nval', {nval}, 'tok', {tok})"

    return F.expr(f"array({', '.join(one(k, v) for k, v in values.items())})").cast(ARGS)


def kind_of_text(value: Column) -> Column:
    """Kind of a written parameter; ``bad`` looks numeric but is no number."""
    low = F.lower(value)
    return (
        F.when(value.rlike(r"^-?\d+$"), "int")
        .when(value.rlike(r"^-?(\d+\.\d*|\.\d+)$"), "float")
        .when(value.rlike(r"^[.\-]*\d[\d.\-]*$"), "bad")
        .when(low.isin("true", "false"), "bool")
        .when(low.isin("null", "none"), "null")
        .otherwise("str")
    )


def kind_of_digits(value: Column) -> Column:
    """Kind under the narrower rule: unsigned digits, at most one point."""
    return (
        F.when(value.rlike(r"^\d+$"), "int")
        .when(value.rlike(r"^(\d+\.\d*|\.\d+)$"), "float")
        .otherwise("str")
    )


def canonical_int(value: Column) -> Column:
    text = F.regexp_replace(value, r"^([+-]?)0+(?=\d)", "$1")
    return F.when(text == "-0", "0").otherwise(text)


def _finished(raw: Column) -> Column:
    """``array<struct<key, kind, text, number>>`` to typed arguments."""
    return F.transform(raw, lambda r: argument(r["key"], r["kind"], r["text"], r["number"]))


def arguments_from_text(pairs: Column) -> Column:
    """``array<struct<key, value, kind>>`` of written values to typed arguments."""

    def read(p: Column) -> Column:
        kind, value = p["kind"], p["value"]
        number = F.when(kind.isin("int", "float"), value.try_cast("double")).when(
            kind == "bool", (F.lower(value) == "true").cast("double")
        )
        text = (
            F.when(kind == "str", value)
            .when(kind == "int", canonical_int(value))
            .when(kind == "float", value.try_cast("double").cast("string"))
            .when(kind == "bool", F.initcap(value))
            .otherwise("None")
        )
        return F.struct(p["key"].alias("key"), kind.alias("kind"), text.alias("text"), number.alias("number"))

    return _finished(F.transform(pairs, read))


def kind_of_json(schema: Column) -> Column:
    """Kind of a JSON value from its schema text. Whole numbers beyond 64 bits are decimals there."""
    return (
        F.when(schema == "STRING", "str")
        .when(schema == "BIGINT", "int")
        .when(schema == "DOUBLE", "float")
        .when(schema == "BOOLEAN", "bool")
        .when(schema.isNull() | (schema == "VOID"), "null")
        .when(schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int")
        .when(schema.startswith("DECIMAL"), "float")
        .otherwise("json")
    )


def arguments_from_variant_map(entries: Column) -> Column:
    """``map<string, variant>`` to typed arguments (empty for a missing map)."""
    seen = F.transform(
        F.map_entries(entries),
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"].alias("value"),
            F.schema_of_variant(e["value"]).alias("schema"),
        ),
    )
    known = F.transform(
        seen,
        lambda s: F.struct(
            s["key"].alias("key"),
            s["value"].alias("value"),
            kind_of_json(s["schema"]).alias("kind"),
            F.try_variant_get(s["value"], "$", "string").alias("text"),
        ),
    )
    read = F.transform(
        known,
        lambda k: F.struct(
            k["key"].alias("key"),
            k["kind"].alias("kind"),
            F.when(k["kind"] == "bool", F.initcap(k["text"]))
            .when(k["kind"] == "null", "None")
            .when(k["kind"] == "float", k["text"].try_cast("double").cast("string"))
            .otherwise(k["text"])
            .alias("text"),
            F.when(k["kind"] == "bool", (k["text"] == "true").cast("double"))
            .when(k["kind"].isin("int", "float"), k["text"].try_cast("double"))
            .alias("number"),
        ),
    )
    return F.coalesce(_finished(read), F.array().cast(ARGS))


def strict_match(expected: Column, predicted: Column) -> Column:
    """Equal; or both text, ignoring case; or both numbers within 0.001."""
    return (
        (expected["tok"] == predicted["tok"])
        | (
            (expected["kind"] == "str")
            & (predicted["kind"] == "str")
            & (F.lower(expected["sval"]) == F.lower(predicted["sval"]))
        )
        | F.coalesce(F.abs(expected["nval"] - predicted["nval"]) < STRICT_TOLERANCE, F.lit(False))
    )


def as_float(value: Column) -> Column:
    return F.when(value["kind"] != "str", value["nval"]).when(
        value["sval"].rlike(FLOAT_TEXT), strip(value["sval"]).try_cast("double")
    )


def as_int(value: Column) -> Column:
    """What Python's ``int()`` makes of the value: numbers are cut toward zero."""
    cut = F.signum(value["nval"]) * F.floor(F.abs(value["nval"]))
    return F.when(value["kind"] != "str", cut).when(
        value["sval"].rlike(INT_TEXT), strip(value["sval"]).try_cast("double")
    )


def lenient_match(expected: Column, predicted: Column) -> Column:
    """Equal; numbers (or number text) within 0.01; same text ignoring case; whole numbers within 1."""
    return (
        (expected["tok"] == predicted["tok"])
        | F.coalesce(F.abs(as_float(expected) - as_float(predicted)) < LENIENT_TOLERANCE, F.lit(False))
        | (F.lower(expected["sval"]) == F.lower(predicted["sval"]))
        | F.coalesce(F.abs(as_int(expected) - as_int(predicted)) <= LENIENT_YEAR_GAP, F.lit(False))
    )
