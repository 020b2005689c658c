"""Scores of predicted against expected calls.

Both sides are array columns of one row (see ``functions.values``), so every score here
is a projection: no join, no shuffle, and a busy sample costs no more than its own rows.
Helper columns are computed in a projection of their own, because an expression written
inside a lambda is evaluated again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.call_text import well_formed
from tallywright.functions.values import lenient_match, strict_match

# Keys the strict parameter score looks at first, weights and pass marks.
KEY_PARAMETERS = ["series_id", "year", "start_year", "end_year", "industry", "state"]
MEAN_PASS = 0.75
WEIGHTS = {"selection": 0.3, "parameters": 0.3, "execution": 0.2, "result": 0.2}
SELECTION_PASS, PARAMETERS_PASS = 0.8, 0.6
PROXY_SELECTION, PROXY_PARAMETERS, PROXY_FACTOR = 0.4, 0.6, 0.8


def _names(calls: Column) -> Column:
    return F.array_distinct(F.transform(calls, lambda c: c["name"]))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(values)


def _none(calls: Column) -> Column:
    return F.size(calls) == 0


def _signatures(calls: Column) -> Column:
    """Calls in the form the pairwise similarity needs: plain arrays of text."""

    def pick(args: Column, null: bool, field) -> Column:
        return F.transform(
            F.filter(args, lambda a: (a["kind"] == "null") if null else (a["kind"] != "null")), field
        )

    key = lambda a: a["key"]
    pair = lambda a: F.concat(a["key"], F.lit("\x01"), a["tok"])
    return F.transform(
        calls,
        lambda c: F.struct(
            c["name"].alias("name"),
            F.transform(c["args"], key).alias("keys"),
            pick(c["args"], False, key).alias("live"),
            pick(c["args"], True, key).alias("nulls"),
            F.sort_array(F.transform(c["args"], pair)).alias("full"),
            pick(c["args"], False, pair).alias("pairs"),
        ),
    )


def _similarity(e: Column, p: Column) -> Column:
    """Half for the name, half for the share of keys with equal values.

    A key that is NULL on one side and absent from the other counts as equal.
    """
    nulls = F.when(F.size(e["nulls"]) + F.size(p["nulls"]) == 0, 0).otherwise(
        F.size(
            F.array_except(
                F.array_union(e["nulls"], p["nulls"]), F.array_union(e["live"], p["live"])
            )
        )
    )
    matched = F.size(F.array_intersect(e["pairs"], p["pairs"])) + nulls
    either = F.size(e["keys"]) + F.size(p["keys"]) - F.size(F.array_intersect(e["keys"], p["keys"]))
    args = (
        F.when((F.size(e["keys"]) == 0) & (F.size(p["keys"]) == 0), 1.0)
        .when((F.size(e["keys"]) == 0) | (F.size(p["keys"]) == 0), 0.0)
        .otherwise(matched / either)
    )
    return F.when(e["name"] == p["name"], 0.5).otherwise(0.0) + 0.5 * args


def call_match(df: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """Add ``is_exact``, ``partial_score`` and ``match_score``.

    Exact: same number of calls which, sorted by name, agree in name and arguments. The
    partial score takes each expected call's best predicted call. Identical predicted
    calls are compared once.
    """

    def in_name_order(sig: Column) -> Column:
        numbered = F.transform(
            sig, lambda s, i: F.struct(s["name"].alias("name"), i.alias("i"), s["full"].alias("full"))
        )
        return F.transform(
            F.sort_array(numbered), lambda s: F.struct(s["name"].alias("name"), s["full"].alias("full"))
        )

    sig = df.withColumns(
        {"_p": _signatures(F.col(predicted)), "_e": _signatures(F.col(expected))}
    ).withColumns({"_distinct": F.array_distinct("_p")})
    p, e, distinct = F.col("_p"), F.col("_e"), F.col("_distinct")
    best = F.transform(
        e, lambda x: F.array_max(F.transform(distinct, lambda y: _similarity(x, y)))
    )
    # Calls that match exactly score 1 without comparing pairs.
    partial = (
        F.when(_none(e) | _none(distinct), 0.0)
        .when(F.col("is_exact"), 1.0)
        .otherwise(_mean(best))
    )
    exact = (
        F.when(_none(e), ~_none(p))
        .when(F.size(p) != F.size(e), False)
        .otherwise(in_name_order(p) == in_name_order(e))
    )
    return (
        sig.withColumn("is_exact", exact)
        .withColumn("partial_score", partial)
        .withColumn("match_score", F.when(F.col("is_exact"), 1.0).otherwise(F.col("partial_score")))
        .drop("_p", "_e", "_distinct")
    )


def selection_exact(predicted: Column, expected: Column) -> Column:
    """1 if both sides name the same set of functions, else 0."""
    same = F.sort_array(_names(predicted)) == F.sort_array(_names(expected))
    return same.cast("double")


def selection_f1(predicted: Column, expected: Column) -> Column:
    """F1 of the two sets of function names; with nothing expected, 1 if nothing was predicted."""
    p, e = _names(predicted), _names(expected)
    return F.when(_none(expected), _none(predicted).cast("double")).otherwise(
        2.0 * F.size(F.array_intersect(p, e)) / (F.size(p) + F.size(e))
    )


def _matched(args: Column, against: Column, rule) -> Column:
    return F.size(
        F.filter(
            args, lambda a: F.exists(against, lambda b: (a["key"] == b["key"]) & rule(a, b))
        )
    )


def parameters_strict(predicted: Column, expected: Column) -> Column:
    """Mean share of matching key parameters per expected function name; 0 if call counts differ.

    The last call of a name counts. Expected calls with none of the key parameters are
    judged on all of theirs. Both arguments must be plain columns.
    """
    pairs = F.transform(
        _names(expected),
        lambda n: F.struct(
            F.try_element_at(F.filter(expected, lambda c: c["name"] == n), F.lit(-1)).alias("e"),
            F.try_element_at(F.filter(predicted, lambda c: c["name"] == n), F.lit(-1)).alias("p"),
        ),
    )
    judged = F.transform(
        pairs,
        lambda x: F.struct(
            x["e"]["args"].alias("all"),
            F.filter(x["e"]["args"], lambda a: a["key"].isin(*KEY_PARAMETERS)).alias("key"),
            x["p"]["args"].alias("p"),
        ),
    )
    chosen = F.transform(
        judged,
        lambda x: F.struct(
            F.when(F.size(x["key"]) > 0, x["key"]).otherwise(x["all"]).alias("e"), x["p"].alias("p")
        ),
    )
    scores = F.transform(
        chosen,
        lambda x: F.when(x["p"].isNull(), 0.0)
        .when(_none(x["e"]), 1.0)
        .otherwise(_matched(x["e"], x["p"], strict_match) / F.size(x["e"])),
    )
    return (
        F.when(_none(expected), 1.0)
        .when(F.size(predicted) != F.size(expected), 0.0)
        .otherwise(_mean(scores))
    )


def parameters_lenient(predicted: Column, expected: Column) -> Column:
    """Mean share of matching parameters per expected call, against the first call of its name."""
    pairs = F.transform(
        expected,
        lambda e: F.struct(
            e["args"].alias("e"),
            F.get(F.filter(predicted, lambda c: c["name"] == e["name"]), F.lit(0))["args"].alias("p"),
        ),
    )
    scores = F.transform(
        pairs,
        lambda x: F.when(x["p"].isNull(), 0.0)
        .when(_none(x["e"]), F.when(_none(x["p"]), 1.0).otherwise(0.5))
        .otherwise(_matched(x["e"], x["p"], lenient_match) / F.size(x["e"])),
    )
    return (
        F.when(_none(expected), _none(predicted).cast("double"))
        .when(_none(predicted), 0.0)
        .otherwise(_mean(scores))
    )


def well_formed_share(predicted: Column) -> Column:
    """Share of predicted calls that are well formed; 0 without calls."""
    good = F.size(F.filter(predicted, well_formed))
    return F.when(_none(predicted), 0.0).otherwise(good / F.size(predicted))


def result_proxy(selection: Column, parameters: Column) -> Column:
    """Stand-in for result accuracy where calls are not run."""
    return (PROXY_SELECTION * selection + PROXY_PARAMETERS * parameters) * PROXY_FACTOR


def mean_verdict(selection: Column, parameters: Column, execution: Column, result: Column) -> dict[str, Column]:
    """Plain mean of four components, passing at three quarters."""
    score = (selection + parameters + execution + result) / 4.0
    return {"is_correct": score >= MEAN_PASS, "score": score}


def weighted_verdict(selection: Column, parameters: Column, execution: Column, result: Column) -> dict[str, Column]:
    """Weighted mean of four components; selection and parameters decide the pass."""
    return {
        "is_correct": (selection >= SELECTION_PASS) & (parameters >= PARAMETERS_PASS),
        "score": WEIGHTS["selection"] * selection
        + WEIGHTS["parameters"] * parameters
        + WEIGHTS["execution"] * execution
        + WEIGHTS["result"] * result,
    }


def catalogue_scores(df: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """The four components and the verdict of the weighted family."""
    p, e = F.col(predicted), F.col(expected)
    parts = df.withColumns(
        {
            "selection": selection_f1(p, e),
            "parameters": parameters_lenient(p, e),
            "execution": well_formed_share(p),
        }
    ).withColumn("result", result_proxy(F.col("selection"), F.col("parameters")))
    c = [F.col(n) for n in ("selection", "parameters", "execution", "result")]
    return parts.withColumns(weighted_verdict(*c))
