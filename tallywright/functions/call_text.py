"""Pull function calls out of an answer, as arrays of typed calls.

Every extractor gives ``array<struct<name, args>>`` (see ``values``) for one answer,
so a whole answer is scored inside its own row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import SPACE, WORD, once, ordered_lookup, strip, strip_chars
from tallywright.functions.values import (
    ARGS,
    CALLS,
    arguments_from_text,
    arguments_from_variant_map,
    kind_of_digits,
    kind_of_text,
    literal_arguments,
)

# The function catalogue, with default values and required keys.
FUNCTION_DEFAULTS = {
    "get_cpi_data": {"series_id": "CUUR0000SA0", "start_year": 2020, "end_year": 2024},
    "get_employment_cost_index": {"series_id": "CIU1010000000000I", "start_year": 2020, "end_year": 2024},
    "get_productivity_data": {"series_id": "PRS85006092", "start_year": 2020, "end_year": 2024},
    "get_gdp_by_industry": {"year": 2023, "industry": "ALL", "table_id": "1"},
    "get_regional_income": {"state": "CA", "year": 2023, "line_code": "SA1-1"},
}
REQUIRED_KEYS = {
    "get_cpi_data": ["start_year", "end_year"],
    "get_employment_cost_index": ["start_year", "end_year"],
    "get_gdp_by_industry": ["year"],
    "get_regional_income": ["state", "year"],
    "get_budget_outlays": [],
}

LABELLED_FUNCTIONS = list(FUNCTION_DEFAULTS)
PLAIN_FUNCTIONS = list(REQUIRED_KEYS)

# All patterns take linear time on long texts. A call's parentheses never span lines, so a
# call runs "up to the first )"; a call left open is matched too, to be passed over in one
# step, and dropped afterwards. The look-behind starts a name only at its first letter.
CALL = rf"(?<!{WORD}){WORD}++\([^)\n]*+\)?+"
PLAIN_PATTERN = rf"(?<!{WORD}){WORD}++{SPACE}*+\([^)\n]*+\)?+"
LABELLED_PATTERNS = [
    rf"(?iu)Function:{SPACE}*({WORD}+){SPACE}*\nParameters:{SPACE}*([^\n]+)",
    rf"(?iu)Function:{SPACE}*({WORD}+){SPACE}*Parameters:{SPACE}*([^\n]+)",
    PLAIN_PATTERN,
    rf"(?iu)call{SPACE}+({WORD}+){SPACE}*\(([^)\n]*)\)",
    rf"(?iu)use{SPACE}+({WORD}+){SPACE}*\(([^)\n]*)\)",
]
PARAMETER = rf"(?<!{WORD}){WORD}++{SPACE}*+={SPACE}*[^,]+"
# Objects without inner braces, or with one level of them.
FLAT_OBJECT = r"\{[^{}]*+\}"
NESTED_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)?\}"
# From a brace to the first closing one; an object left open is matched once, and is no JSON.
SHORTEST_OBJECT = r"\{[^}]*+(?:\}|\z)"

JSON_ITEM = (
    "struct<name:string,function_name:string,arguments:variant,parameters:variant>"
)


def no_calls() -> Column:
    return F.array().cast(CALLS)


def _if_any(calls: Column) -> Column:
    return F.when(F.size(calls) > 0, calls)


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.instr(text, mark) + F.lit(len(mark)))


def keep_last_of_key(args: Column) -> Column:
    """A repeated key keeps its last value. The slow branch runs only where a key repeats."""

    def keys(arr: Column) -> Column:
        return F.transform(arr, lambda a: a["key"])

    def last_only(arr: Column) -> Column:
        return F.filter(
            arr,
            lambda a, i: ~F.array_contains(
                keys(F.slice(arr, i + F.lit(2), F.size(arr))), a["key"]
            ),
        )

    return once(
        args,
        lambda arr: F.when(F.size(F.array_distinct(keys(arr))) == F.size(arr), arr).otherwise(
            last_only(arr)
        ),
    )


def _with_kind(pairs: Column, kind_of) -> Column:
    """``array<struct<key, value>>`` with the kind of each value added."""
    return F.transform(
        pairs,
        lambda p: F.struct(
            p["key"].alias("key"), p["value"].alias("value"), kind_of(p["value"]).alias("kind")
        ),
    )


def _key_and_value(pair: Column) -> Column:
    """Split a written pair at its first ``=``; quotes around the value are dropped."""
    return F.struct(
        strip(_before(pair, "=")).alias("key"),
        strip_chars(strip(_after(pair, "=")), "\"'").alias("value"),
    )


def parse_labelled_parameters(params: Column) -> Column:
    """``key = value`` pairs, typed; the first malformed number drops its own and all later pairs."""

    def read(pair: Column) -> Column:
        both = _key_and_value(pair)
        return F.struct(both["key"].alias("key"), strip(both["value"]).alias("value"))

    def cut(arr: Column) -> Column:
        first_bad = F.array_position(F.transform(arr, lambda a: a["kind"]), "bad").cast("int")
        return once(
            first_bad,
            lambda n: F.when(n == 0, arr).otherwise(F.slice(arr, F.lit(1), n - F.lit(1))),
        )

    pairs = F.transform(F.regexp_extract_all(params, F.lit(PARAMETER), F.lit(0)), read)
    return keep_last_of_key(arguments_from_text(once(_with_kind(pairs, kind_of_text), cut)))


def parse_plain_arguments(params: Column, typed: bool) -> Column:
    """Comma-separated ``key=value`` pairs; pieces without ``=`` are skipped."""
    pairs = F.transform(
        F.filter(F.split(params, ","), lambda p: p.contains("=")), _key_and_value
    )
    kind_of = kind_of_digits if typed else (lambda v: F.lit("str"))
    return keep_last_of_key(arguments_from_text(_with_kind(pairs, kind_of)))


def _closed(response: Column, pattern: str) -> Column:
    """Matches of a call pattern, without calls left open."""
    matches = F.regexp_extract_all(response, F.lit(pattern), F.lit(0))
    return F.filter(matches, lambda m: m.endswith(")"))


def _name_and_params(match: Column) -> Column:
    """Split ``name (params)`` at its parenthesis."""
    inner = _after(match, "(")
    return F.struct(
        strip(_before(match, "(")).alias("name"),
        F.substr(inner, F.lit(1), F.length(inner) - F.lit(1)).alias("params"),
    )


def calls_in_text(response: Column, typed: bool, names: list[str] | None = None) -> Column:
    """Every ``word(...)``, or only those whose word is one of ``names``."""
    parts = F.transform(_closed(response, CALL), _name_and_params)
    if names is not None:
        parts = F.filter(parts, lambda p: p["name"].isin(*names))
    return F.transform(
        parts,
        lambda p: F.struct(
            p["name"].alias("name"), parse_plain_arguments(p["params"], typed).alias("args")
        ),
    ).cast(CALLS)


def _arguments(value: Column) -> Column:
    return arguments_from_variant_map(F.try_variant_get(value, "$", "map<string,variant>"))


def calls_from_items(items: Column) -> Column:
    """Parsed JSON items, under either pair of key names, to typed calls."""
    return F.transform(
        items,
        lambda c: F.struct(
            F.coalesce(c["function_name"], c["name"]).alias("name"),
            _arguments(F.coalesce(c["parameters"], c["arguments"])).alias("args"),
        ),
    ).cast(CALLS)


def calls_from_json(text: Column) -> Column:
    """A JSON list of calls, as stored in question sets; anything else gives no calls."""
    items = F.from_json(text, f"array<{JSON_ITEM}>")
    return F.coalesce(calls_from_items(items), no_calls())


def extract_calls_json_and_text(response: Column, nested: bool = False) -> Column:
    """JSON objects with name and arguments, followed by every ``word(...)`` with text values.

    The name must come first. Objects with braces inside are skipped unless ``nested`` is set.
    """
    objects = F.transform(
        F.filter(
            F.regexp_extract_all(response, F.lit(NESTED_OBJECT if nested else FLAT_OBJECT), F.lit(0)),
            lambda m: m.contains('"name"') & _after(m, '"name"').contains('"arguments"'),
        ),
        lambda m: F.from_json(m, "struct<name:string,arguments:variant>"),
    )
    from_json = F.transform(
        F.filter(objects, lambda o: o["name"].isNotNull()),
        lambda o: F.struct(o["name"].alias("name"), _arguments(o["arguments"]).alias("args")),
    ).cast(CALLS)
    return F.concat(from_json, calls_in_text(response, typed=False))


def is_one_json_value(text: Column) -> Column:
    """The whole text is one JSON value. Spark's parser alone would ignore text after it."""
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(in_list, "$[1]", "variant").isNull()
    return in_list.isNotNull() & in_object.isNotNull() & alone


def extract_calls_tiered(response: Column, nested: bool = False) -> Column:
    """Flat JSON objects; else the whole answer as JSON; else ``word(...)`` of known functions."""
    item = "struct<function_name:string,parameters:variant>"
    pattern = NESTED_OBJECT if nested else SHORTEST_OBJECT

    def to_calls(items: Column) -> Column:
        return F.transform(
            F.filter(items, lambda o: o["function_name"].isNotNull()),
            lambda o: F.struct(
                o["function_name"].alias("name"), _arguments(o["parameters"]).alias("args")
            ),
        ).cast(CALLS)

    flat = F.transform(
        F.regexp_extract_all(response, F.lit(pattern), F.lit(0)), lambda m: F.from_json(m, item)
    )
    start = F.substring(strip(response), 1, 1)
    whole = F.when(
        start.isin("[", "{") & is_one_json_value(response),
        F.when(start == "[", F.from_json(response, f"array<{item}>")).otherwise(
            F.array(F.from_json(response, item))
        ),
    )
    tiers = [
        to_calls(flat),
        F.coalesce(to_calls(whole), no_calls()),
        calls_in_text(response, typed=True, names=PLAIN_FUNCTIONS),
    ]
    # coalesce stops at the first tier that found something
    return F.coalesce(*[once(t, _if_any) for t in tiers], no_calls())


def default_arguments(name: Column) -> Column:
    return ordered_lookup(
        name,
        {f: literal_arguments(d) for f, d in FUNCTION_DEFAULTS.items()},
        F.array().cast(ARGS),
    )


def mentioned_calls(response: Column) -> Column:
    """Known functions named anywhere in the answer, in catalogue order, with their defaults."""
    low = F.lower(response)
    hits = [
        F.when(
            low.contains(f),
            F.struct(F.lit(f).alias("name"), literal_arguments(d).alias("args")),
        )
        for f, d in FUNCTION_DEFAULTS.items()
    ]
    return F.filter(F.array(*hits), lambda c: c.isNotNull()).cast(CALLS)


def extract_calls_labelled(response: Column, dedupe: bool = False) -> Column:
    """Calls under five written forms, form by form; overlapping forms repeat a call.

    ``dedupe`` drops such repeats. Without any call, mentioned functions count with defaults.
    """

    def under(pattern: str) -> Column:
        def split(match: Column) -> Column:
            if pattern == PLAIN_PATTERN:
                return _name_and_params(match)
            return F.struct(
                F.regexp_extract(match, pattern, 1).alias("name"),
                F.regexp_extract(match, pattern, 2).alias("params"),
            )

        if pattern == PLAIN_PATTERN:
            matches = _closed(response, pattern)
        else:
            matches = F.regexp_extract_all(response, F.lit(pattern), F.lit(0))
        return F.filter(F.transform(matches, split), lambda p: p["name"].isin(*LABELLED_FUNCTIONS))

    written = F.transform(
        F.concat(*[under(p) for p in LABELLED_PATTERNS]),
        lambda p: F.struct(
            p["name"].alias("name"), parse_labelled_parameters(p["params"]).alias("args")
        ),
    ).cast(CALLS)
    if dedupe:
        written = F.array_distinct(written)
    return F.coalesce(once(written, _if_any), mentioned_calls(response))


def argument_of(args: Column, key: str) -> Column:
    """The argument with this key, or NULL."""
    return F.get(F.filter(args, lambda a: a["key"] == key), F.lit(0))


def with_defaults(call: Column) -> Column:
    """The call's arguments, completed by the function's defaults for keys it leaves out."""

    def complete(c: Column) -> Column:
        missing = F.filter(
            default_arguments(c["name"]),
            lambda d: ~F.exists(c["args"], lambda a: a["key"] == d["key"]),
        )
        return F.concat(c["args"], missing)

    return once(call, complete)


def argument_or_default(name: Column, args: Column, key: str) -> Column:
    """Text of an argument, or of the function's default where the call leaves it out."""
    defaults = {f: F.lit(str(d[key])) for f, d in FUNCTION_DEFAULTS.items() if key in d}
    return F.coalesce(
        argument_of(args, key)["sval"], ordered_lookup(name, defaults, F.lit(None).cast("string"))
    )


def well_formed(call: Column) -> Column:
    """The function is known and every required key is present."""
    keys = F.transform(call["args"], lambda a: a["key"])
    checks = {
        f: F.size(F.array_except(F.array(*[F.lit(k) for k in need]).cast("array<string>"), keys)) == 0
        for f, need in REQUIRED_KEYS.items()
    }
    return ordered_lookup(call["name"], checks, F.lit(False))
