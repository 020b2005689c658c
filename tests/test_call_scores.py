"""Call scores against a brute-force scorer over random call lists."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions import call_text
from tallywright.functions.values import lenient_match, strict_match
from tallywright.operators import call_scores as cs

NAMES = ["get_cpi_data", "get_gdp_by_industry", "get_budget_outlays", "other"]
KEYS = ["year", "state", "note"]
VALUES = [2016, 2017, 2016.0, 2016.0005, "2016", "2017", "CA", "ca", None, "None", True, 1, [1, 2], {"a": 1}]


def _random_calls(rng):
    return [
        {"name": rng.choice(NAMES), "arguments": {k: rng.choice(VALUES) for k in KEYS if rng.random() < 0.5}}
        for _ in range(rng.randint(0, 3))
    ]


def _number(v):
    return isinstance(v, (int, float))


def _float(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _whole(v):
    try:
        return int(v)
    except (TypeError, ValueError):
        return None


def _strict(a, b):
    if a == b:
        return True
    if isinstance(a, str) and isinstance(b, str):
        return a.lower() == b.lower()
    return _number(a) and _number(b) and abs(a - b) < 0.001


def _lenient(a, b):
    if a == b or str(a).lower() == str(b).lower():
        return True
    for read, near in ((_float, lambda d: d < 0.01), (_whole, lambda d: d <= 1)):
        x, y = read(a), read(b)
        if x is not None and y is not None and near(abs(x - y)):
            return True
    return False


def _alike(e, p):
    a, b = e["arguments"], p["arguments"]
    keys = a.keys() | b.keys()
    if not keys:
        args = 1.0
    elif a and b:
        args = sum(a.get(k) == b.get(k) for k in keys) / len(keys)
    else:
        args = 0.0
    return 0.5 * (e["name"] == p["name"]) + 0.5 * args


def _match(pred, exp):
    if not exp:
        return bool(pred), float(bool(pred))
    if not pred:
        return False, 0.0
    by_name = lambda calls: sorted(calls, key=lambda c: c["name"])
    if len(pred) == len(exp) and by_name(pred) == by_name(exp):
        return True, 1.0
    return False, sum(max(_alike(e, p) for p in pred) for e in exp) / len(exp)


def _f1(pred, exp):
    if not exp:
        return float(not pred)
    p, e = {c["name"] for c in pred}, {c["name"] for c in exp}
    return 2 * len(p & e) / (len(p) + len(e))


def _params_strict(pred, exp):
    if not exp:
        return 1.0
    if len(pred) != len(exp):
        return 0.0
    p = {c["name"]: c["arguments"] for c in pred}
    e = {c["name"]: c["arguments"] for c in exp}
    total = 0.0
    for name, args in e.items():
        judged = {k: v for k, v in args.items() if k in cs.KEY_PARAMETERS} or args
        if name in p:
            hits = [k in p[name] and _strict(v, p[name][k]) for k, v in judged.items()]
            total += sum(hits) / len(hits) if hits else 1.0
    return total / len(e)


def _params_lenient(pred, exp):
    if not exp:
        return float(not pred)
    total = 0.0
    for e in exp:
        p = next((c["arguments"] for c in pred if c["name"] == e["name"]), None)
        if p is None:
            continue
        hits = [k in p and _lenient(v, p[k]) for k, v in e["arguments"].items()]
        total += sum(hits) / len(hits) if hits else (0.5 if p else 1.0)
    return total / len(exp)


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(7)
    pairs = [(_random_calls(rng), _random_calls(rng)) for _ in range(400)]
    # Permuted copies make exact matches frequent.
    pairs += [(rng.sample(e, len(e)), e) for _, e in pairs[:100]]
    rows = [(i, json.dumps(p), json.dumps(e)) for i, (p, e) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, p string, e string").select(
        "i",
        call_text.calls_from_json(F.col("p")).alias("predicted"),
        call_text.calls_from_json(F.col("e")).alias("expected"),
    )
    return pairs, df


def _check(cases, column, want):
    pairs, df = cases
    got = {r.i: r.out for r in df.select("i", column.alias("out")).collect()}
    assert len(got) == len(pairs)
    for i, (p, e) in enumerate(pairs):
        assert got[i] == pytest.approx(want(p, e)), (p, e)


def test_match(cases):
    pairs, df = cases
    rows = {r.i: r for r in cs.call_match(df).collect()}
    exact = 0
    for i, (p, e) in enumerate(pairs):
        want = _match(p, e)
        exact += want[0]
        assert rows[i].is_exact is want[0], (p, e)
        assert rows[i].match_score == pytest.approx(want[1]), (p, e)
    assert exact > 30


def test_selection(cases):
    p, e = F.col("predicted"), F.col("expected")
    same = lambda a, b: float({c["name"] for c in a} == {c["name"] for c in b})
    _check(cases, cs.selection_exact(p, e), same)
    _check(cases, cs.selection_f1(p, e), _f1)


def test_parameters(cases):
    p, e = F.col("predicted"), F.col("expected")
    _check(cases, cs.parameters_strict(p, e), _params_strict)
    _check(cases, cs.parameters_lenient(p, e), _params_lenient)


def test_catalogue_verdict(cases):
    pairs, df = cases
    for r in cs.catalogue_scores(df).collect():
        p, e = pairs[r.i]
        select, params = _f1(p, e), _params_lenient(p, e)
        assert r.result == pytest.approx((0.4 * select + 0.6 * params) * 0.8)
        assert r.score == pytest.approx(0.3 * select + 0.3 * params + 0.2 * r.execution + 0.2 * r.result)
        assert r.is_correct is (select >= 0.8 and params >= 0.6)


def test_value_rules(spark):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    rows = [
        (i, json.dumps([{"name": "f", "arguments": {"k": a}}]), json.dumps([{"name": "f", "arguments": {"k": b}}]))
        for i, (a, b) in enumerate(pairs)
    ]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = (call_text.calls_from_json(F.col(c))[0]["args"][0] for c in ("a", "b"))
    out = df.select("i", strict_match(a, b).alias("s"), lenient_match(a, b).alias("l")).collect()
    for r in out:
        x, y = pairs[r.i]
        assert r.s is _strict(x, y), (x, y)
        assert r.l is _lenient(x, y), (x, y)
