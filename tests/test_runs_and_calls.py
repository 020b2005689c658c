"""Rows that calls return, the store of runs, missing answers and models in pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import metrics, presence, returned_rows
from tallywright.operators.positions import dense_positions
from tallywright.operators.statement_runs import by_result, run_statements, statement_id
from tallywright.plans import evaluations
from tallywright.sources import run_store, sinks

POINTS = "domain string, key string, measure string, year int, period int, value double"
SPANS = "answer int, call_pos int, function_name string, domain string, key string, measure string, low int, high int"


@pytest.mark.parametrize(("width", "hot"), [(4, 1 << 16), (1, 1), (3, 5), (7, 2)])
def test_returned_rows_equal_nested_loops(spark, width, hot):
    rng = random.Random(7)
    points = [("series", rng.choice("ab"), "", rng.randrange(1990, 2010), rng.randrange(12), float(i)) for i in range(150)]
    points += [("series", "c", "", 2000, 1, 1.0)] * 9 + [("series", None, "", 2000, 1, 1.0), ("series", "a", "", None, 1, 1.0), ("state", "a", "SA1-1", 2000, None, 2.0)]
    points += [("series", "a", "", -5, 1, 3.0)]
    spans = []
    for i in range(60):
        low = rng.choice([rng.randrange(1985, 2012), -(2**31), 2000])
        high = rng.choice([low, low + rng.randrange(9), 2**31 - 1])
        spans.append((i % 50, i % 3, "f", rng.choice(["series", "series", "state"]), rng.choice("abcz"), rng.choice(["", "SA1-1"]), low, min(high, 2**31 - 1)))
    spans = [s for s in spans if s[6] <= s[7]]
    expected = sorted(
        (s[0], s[1], *p[:3], p[3], p[4] if p[4] is not None else -1, p[5]) for s in spans for p in points if p[:3] == s[3:6] and p[3] is not None and s[6] <= p[3] <= s[7]
    )
    out = returned_rows.returned_rows(spark.createDataFrame(spans, SPANS), spark.createDataFrame(points, POINTS), width, hot)
    got = sorted((r.answer, r.call_pos, r.domain, r.key, r.measure, r.year, r.period if r.period is not None else -1, r.value) for r in out.collect())
    assert got == expected and expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_returned_rows_of_nothing(spark):
    spans, points = spark.createDataFrame([(1, 0, "f", "series", "a", "", 1, 9)], SPANS), spark.createDataFrame([], POINTS)
    assert returned_rows.returned_rows(spans, points).collect() == []
    assert returned_rows.returned_rows(spans.limit(0), spark.createDataFrame([("series", "a", "", 3, 1, 1.0)], POINTS)).collect() == []


def test_fact_points_know_line_codes_and_all_industries(spark):
    series = spark.createDataFrame([("s", 2001, 3, 1.5)], "series_id string, year int, period_value int, numeric_value double")
    industry = spark.createDataFrame([("mining", 2001, 2.5)], "industry_name string, year int, gdp_value double")
    regional = spark.createDataFrame([("CA", 2001, 10.0, 4, 2.5)], "state_name string, year int, personal_income double, population bigint, per_capita_income double")
    got = {(r.domain, r.key, r.measure): r.value for r in returned_rows.fact_points(series, industry, regional).collect()}
    assert got[("series", "s", "")] == 1.5
    assert got[("industry", "mining", "")] == got[("industry", "ALL", "")] == 2.5
    assert {v for (d, k, _), v in got.items() if d == "state"} == {10.0, 4.0, 2.5}


def results(spark, rows):
    """(run, model, sample, right, score)"""
    full = [(r, m, s, "q", "sql" if s % 2 else "function", "easy", "x", ok, score, 1.0 if s % 3 else None, None if ok else "E", "{}") for r, m, s, ok, score in rows]
    schema = (
        "run_id string, model string, sample_id bigint, question string, evaluation_type string, difficulty string, model_response string, "
        "is_correct boolean, score double, execution_time double, error_message string, validation_details string"
    )
    return spark.createDataFrame(full, schema).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def keys(df):
    return sorted((r.run_id or "", r.model or "", r.sample_id, r.is_correct) for r in df.collect())


def test_a_rewritten_run_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "store")
    first = results(spark, [("007", "m/1", 1, True, 1.0), ("007", "m/1", 2, False, 0.0), ("7", "m2", 1, True, 0.5), (None, None, 9, True, 1.0)])
    run_store.write_run(first, path)
    assert keys(run_store.read_runs(spark, path)) == keys(first)
    run_store.write_run(results(spark, [("007", "m/1", 5, True, 0.25)]), path)
    assert keys(run_store.read_runs(spark, path)) == [("", "", 9, True), ("007", "m/1", 5, True), ("7", "m2", 1, True)]
    assert keys(run_store.read_runs(spark, path, ["7"])) == [("7", "m2", 1, True)]
    assert run_store.remove_superseded(spark, path) == 1
    assert len(keys(run_store.read_runs(spark, path))) == 3
    assert run_store.remove_superseded(spark, path) == 0


def test_unfinished_and_repeated_writes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = results(spark, [("a", "m", 1, True, 1.0), ("b", "m", 1, False, 0.0)])
    run_store.write_run(rows, path)
    version = run_store.stage_run(results(spark, [("a", "m", 1, False, 0.0), ("a", "m", 2, False, 0.0)]), path)
    assert keys(run_store.read_runs(spark, path)) == keys(rows)  # not committed
    # The write is tried again, with fewer rows, and its commit is repeated.
    assert run_store.stage_run(results(spark, [("a", "m", 2, False, 0.0)]), path, version) == version
    run_store.commit_run(spark, path, version)
    run_store.commit_run(spark, path, version)
    assert keys(run_store.read_runs(spark, path)) == [("a", "m", 2, False), ("b", "m", 1, False)]


def test_reading_a_run_lists_its_folders_only(spark, tmp_path):
    path = str(tmp_path / "store")
    for run in "abc":
        run_store.write_run(results(spark, [(run, "m", k, True, 1.0) for k in range(4)]), path)
    plan = run_store.read_runs(spark, path, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run_id" in plan.split("PartitionFilters")[1]


def test_reports_merge_the_cells_of_commits(spark, tmp_path):
    path = str(tmp_path / "store")
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice("xy"), s, rng.random() < 0.5, round(rng.random(), 3)) for s in range(200)]
    parts = [rows[:50], rows[50:120], rows[120:]]
    # Each write holds other runs; the last one replaces what a run of the first held.
    for k, part in enumerate(parts):
        run_store.write_run(results(spark, [(f"{r}{k}", *rest) for r, *rest in part]), path)
    run_store.write_run(results(spark, [("a0", "x", 1, True, 1.0)]), path)
    live = run_store.read_runs(spark, path)
    cells = run_store.committed_cells(spark, path)
    for by in (None, ["run_id", "model"]):
        expected = sorted(map(str, metrics.all_metrics(live, by).collect()))
        assert sorted(map(str, metrics.metrics_of_cells(cells, by).collect())) == expected
    expected = sorted(map(str, metrics.pass_summary(live, "run_id").collect()))
    assert sorted(map(str, metrics.pass_summary_of_cells(cells, "run_id").collect())) == expected
    files = cells.inputFiles()
    assert files and all("/commits/" in f for f in files)  # no result is read


def test_saved_results_are_read_back(spark, tmp_path):
    rows = results(spark, [("a", "m", 1, True, 1.0), ("b", "n", 2, False, 0.5)])
    paths = sinks.save_results(rows, str(tmp_path / "out"))
    assert keys(run_store.read_runs(spark, paths["runs_path"], ["b"])) == [("b", "n", 2, False)]
    # JSON of one run is rewritten in place of its own folder only.
    sinks.write_results_json(rows.where("run_id = 'a'"), paths["json_path"])
    assert {r.run_id for r in spark.read.json(paths["json_path"]).collect()} == {"a", "b"}


def test_missing_answers_are_wrong_results(spark):
    ids = [(f"s{k}", "q", "sql", "easy") for k in range(500)] + [(None, "q", "sql", "hard")]
    samples = spark.createDataFrame(ids, "sample_id string, question string, evaluation_type string, difficulty string")
    rng = random.Random(2)
    given = [(run, "m", f"s{k}", "x", None) for run in ("full", "half", "few") for k in range(500) if run == "full" or rng.random() < {"half": 0.5, "few": 0.01}[run]]
    given += [("full", "m", None, "x", None), ("few", "m", "unknown", "x", None), ("few", "m", "s1", "x", None), ("few", "m", "s1", "x", None), (None, None, "s2", "x", None)]
    answers = spark.createDataFrame(given, "run_id string, model string, sample_id string, content string, error string")
    answers = answers.withColumns({"prompt_tokens": F.lit(0), "completion_tokens": F.lit(0)})
    wanted = {i[0] for i in ids}
    expected = {(run, s) for run in ("full", "half", "few", None) for s in wanted - {g[2] for g in given if g[0] == run}}
    got = [(r.run_id, r.sample_id) for r in evaluations.unanswered(samples, answers).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    wrong = evaluations.missing_results(samples.na.drop(), answers).collect()
    assert all((r.is_correct, r.score, r.error_message) == (False, 0.0, evaluations.NO_ANSWER) for r in wrong)
    assert {(r.run_id, r.sample_id) for r in wrong} == {e for e in expected if e[1] is not None}
    assert evaluations.unanswered(samples.limit(0), answers).collect() == []


def test_models_in_pairs_equal_sets(spark):
    rng = random.Random(3)
    rows = [("r", m, rng.randrange(300), rng.random() < p, 0.0) for m, p in (("a", 0.9), ("b", 0.5), ("c", 0.2)) for _ in range(250)]
    right, seen = {}, {}
    for _, m, s, ok, _ in rows:
        seen.setdefault(m, set()).add(s)
        right[m, s] = right.get((m, s), True) and ok
    got = {(r.model_a, r.model_b): r for r in presence.pairwise_models(results(spark, rows)).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in got.items():
        common = seen[x] & seen[y]
        assert r.common_samples == len(common)
        assert r.both_right == sum(right[x, s] and right[y, s] for s in common)
        assert r.only_a_right == sum(right[x, s] and not right[y, s] for s in common)
        assert r.only_b_right == sum(right[y, s] and not right[x, s] for s in common)


def test_statements_of_one_meaning_run_once(spark):
    spark.createDataFrame([(1, 2), (3, 4)], "a int, b int").createOrReplaceTempView("left_table")
    spark.createDataFrame([(5, 6), (7, 8)], "a int, b int").createOrReplaceTempView("right_table")
    same = ["SELECT a FROM left_table", "select  a as x from left_table", "SELECT l.a FROM left_table l"]
    others = [
        "SELECT a FROM right_table",  # a table of the same form
        "SELECT a, a FROM left_table",  # a repeated name hides a column
        "SELECT a AS x, a AS y FROM left_table",
        "SELECT a FROM left_table WHERE a IN (SELECT a FROM left_table)",
        "SELECT a FROM left_table WHERE a IN (SELECT a FROM right_table)",
        "SELECT l.a FROM left_table l JOIN right_table r ON l.a = r.a",
        "SELECT l.a FROM right_table l JOIN left_table r ON l.a = r.a",
        "WITH t AS (SELECT a FROM left_table) SELECT a FROM t",
        "WITH t AS (SELECT a FROM right_table) SELECT a FROM t",
        "SELECT rand() AS x FROM left_table",
        "SELECT rand() AS y FROM left_table",
        "SELECT broken FROM left_table",
        "DROP TABLE left_table",
    ]
    asked = spark.createDataFrame([(s,) for s in same + others], "sql string")
    tables = ["left_table", "right_table"]
    status, rows = run_statements(asked, cleaned=True, tables=tables, by_meaning=True)
    plain, plain_rows = run_statements(asked, cleaned=True, tables=tables)
    got = {r.sql: (r.status, r.result_id) for r in asked.withColumn("sql_id", statement_id(F.col("sql"), True)).join(status, "sql_id").collect()}
    assert len({got[s][1] for s in same}) == 1
    assert len({got[s][1] for s in others} | {got[same[0]][1]}) == len(others) + 1
    assert {(r.sql_id, r.status) for r in status.collect()} == {(r.sql_id, r.status) for r in plain.collect()}
    # The shared rows are those that each statement has on its own.
    keyed = lambda df: sorted((r.sql_id, r.pos, tuple(r.row_key), tuple(r.ordered_key)) for r in df.collect())
    steady = {r.sql_id for r in asked.where("sql NOT LIKE '%rand%'").select(statement_id(F.col("sql"), True).alias("sql_id")).collect()}
    expanded = status.join(rows.withColumnRenamed("sql_id", "result_id"), "result_id")
    assert [k for k in keyed(expanded) if k[0] in steady] == [k for k in keyed(plain_rows) if k[0] in steady]
    pairs = status.select("sql_id", F.lit(1).alias("sample_id"))
    assert by_result(pairs, status, "sql_id").count() == len(others) + 1


@pytest.mark.parametrize("range_rows", [1 << 18, 10, 1])
def test_positions_of_null_groups_and_values(spark, range_rows):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, rng.randrange(-50, 50), 10**12 + rng.randrange(9)]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, o bigint, i int")
    got = {r.i: r.pos for r in dense_positions(df, ["g"], "o", ties=["i"], range_rows=range_rows).collect()}
    assert len(got) == 300
    for group in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[i] for *_, i in own] == list(range(1, len(own) + 1))
