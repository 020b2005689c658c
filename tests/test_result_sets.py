"""Result-set comparison against brute force."""

import difflib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.operators import result_sets as rs
from tallywright.operators.positions import dense_positions


def _tables(spark, sets):
    sides = []
    for side in (0, 1):
        rows = [(i, pos + 1, [str(v)]) for i, pair in enumerate(sets) for pos, v in enumerate(pair[side])]
        sides.append(spark.createDataFrame(rows, "k int, pos bigint, row_key array<string>"))
    return sides


rows = st.lists(st.integers(0, 9), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(rows, rows), min_size=20, max_size=40))
def test_similarity_is_the_block_matching_ratio(spark, sets):
    got = {r.k: r.similarity for r in rs.result_similarity(*_tables(spark, sets), ["k"]).collect()}
    for i, (c, e) in enumerate(sets):
        if not c and not e:
            assert i not in got
            continue
        a, b = sorted(map(str, c)), sorted(map(str, e))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0
        assert got[i] == pytest.approx(want)


def test_ordered_equality(spark):
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 5))]
        sets.append((a, rng.choice([a, a[::-1], a + [1], [7, *a[1:]]])))
    got = {r.k: r.is_equal for r in rs.ordered_equality(*_tables(spark, sets), ["k"]).collect()}
    assert got == {i: a == b for i, (a, b) in enumerate(sets)}


def test_row_keys(spark):
    df = spark.createDataFrame([(1, 1.0, "1", None, True), (2, 2.5, "b", "x", False)], "i int, d double, s string, n string, b boolean")
    cols = ["i", "d", "s", "n", "b"]
    un = [r.k for r in df.select(rs.unordered_row_key(df, cols).alias("k")).collect()]
    assert un == [["1", "1", "1", "1.0", "None"], ["0", "2", "2.5", "b", "x"]]
    ordered = [r.k for r in df.select(rs.ordered_row_key(df, cols).alias("k")).collect()]
    # 1 equals 1.0 but not "1".
    assert ordered == [["n:1", "n:1", "s:1", "null", "n:1"], ["n:2", "n:2.5", "s:b", "s:x", "n:0"]]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_dense_positions_with_a_hot_group(spark, width):
    rng = random.Random(5)
    data = [(0 if i % 3 else rng.randint(1, 9), rng.randint(-500, 500), i) for i in range(900)]
    df = spark.createDataFrame(data, "g int, o bigint, i int")
    got = dense_positions(df, ["g"], "o", ties=["i"], range_rows=width).collect()
    want = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted(x for x in data if x[0] == g)):
            want[d[2]] = n + 1
    assert {r.i: r.pos for r in got} == want


@pytest.mark.parametrize(
    "executed, expects, similarity, correct, score",
    [
        (True, True, 0.9, True, 0.94),
        (True, True, 0.89, False, 0.934),
        (True, False, None, True, 1.0),
        (True, True, None, False, 0.4),
        (False, False, None, False, 0.0),
        (None, True, 1.0, False, 0.0),
    ],
)
def test_sql_verdict(spark, executed, expects, similarity, correct, score):
    df = spark.createDataFrame([(executed, expects, similarity)], "x boolean, e boolean, s double")
    row = df.select(*[c.alias(k) for k, c in rs.sql_verdict(F.col("x"), F.col("e"), F.col("s")).items()]).first()
    assert row.is_correct is correct and row.score == pytest.approx(score)
