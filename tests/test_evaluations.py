"""Whole evaluations over small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tallywright.functions import prompts
from tallywright.functions.call_text import extract_calls_labelled
from tallywright.operators import metrics, statement_runs
from tallywright.operators.call_execution import (
    fact_coverage,
    result_accuracy,
    with_requests,
)
from tallywright.plans import evaluations
from tallywright.sources import question_sets, sinks
from tallywright.sources.fact_tables import FACT_COLUMNS, register_facts
from tallywright.sources.responses import read_responses


@pytest.fixture(scope="module")
def facts(spark):
    budget = spark.createDataFrame(
        [(1, "Defense", 2016, 10.0), (2, "Health", 2016, 20.5), (3, "Defense", 2017, 30.0)],
        "record_id bigint, function_name string, fiscal_year int, outlay_amount double",
    )
    return {"budget_outlays": budget}


@pytest.fixture(scope="module")
def coverage(spark):
    series = spark.createDataFrame([("CUUR0000SA0", 2016), ("CUUR0000SA0", 2016)], "series_id string, year int")
    gdp = spark.createDataFrame([("SMALL", 2016), ("LARGE", 2023)], "industry_name string, year int")
    region = spark.createDataFrame([("CA", 2023)], "state_name string, year int")
    return fact_coverage(series, gdp, region)


def _sql_documents(tmp_path, questions, root="questions"):
    path = tmp_path / "sql.json"
    path.write_text(json.dumps({root: questions}))
    return str(path)


def _responses(spark, rows):
    full = [(*r, 10, 5, None) for r in rows]
    return spark.createDataFrame(
        full,
        "sample_id string, model string, content string, execution_time_ms double, error string, "
        "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint",
    )


def test_sql_evaluation(spark, facts, tmp_path):
    path = _sql_documents(
        tmp_path,
        [
            {"question_id": "a", "question_text": "How much?", "expected_result": [{"n": "Defense", "t": 40.0}, {"n": "Health", "t": 20.5}]},
            {"question_id": "b", "question": "No rows expected", "expected_result": []},
            {"question_id": "c", "question": "Nothing to compare", "difficulty": None},
        ],
    )
    samples = question_sets.sql_samples(question_sets.read_documents(spark, path))
    grouped = "SELECT function_name, SUM(outlay_amount) FROM budget_outlays GROUP BY function_name"
    answers = _responses(
        spark,
        [
            ("a", "m1", f"```sql\n{grouped} -- done\n```", 1500.0, None),
            ("a", "m2", "SELECT function_name, 1 FROM budget_outlays", None, None),
            ("a", "m3", "SELECT * FROM budget_outlays WHERE record_id < 0", None, None),
            ("b", "m1", "SELECT 1 WHERE false", None, None),
            ("b", "m2", "DROP TABLE budget_outlays", None, None),
            ("c", "m1", "I cannot say", None, None),
            ("c", "m2", "SELECT nope FROM budget_outlays", None, None),
            ("c", "m3", "", 1.0, "timeout"),
            ("c", "m4", "SELECT 1 / (record_id - 1) FROM budget_outlays", None, None),
        ],
    )
    results = evaluations.evaluate_sql(samples, answers, facts)
    got = {(r.sample_id, r.model): r for r in results.collect()}
    assert len(got) == 9
    scores = {k: (r.is_correct, round(r.score, 6)) for k, r in got.items()}
    assert scores == {
        ("a", "m1"): (True, 1.0),
        ("a", "m2"): (False, 0.4),
        ("a", "m3"): (False, 0.4),
        ("b", "m1"): (True, 1.0),
        ("b", "m2"): (False, 0.0),
        ("c", "m1"): (False, 0.0),
        ("c", "m2"): (False, 0.0),
        ("c", "m3"): (False, 0.0),
        ("c", "m4"): (False, 0.0),
    }
    assert got["c", "m3"].error_message == "timeout" and got["a", "m1"].execution_time == 1.5
    assert got["a", "m1"].difficulty == "medium"
    assert json.loads(got["c", "m1"].validation_details)["execution_details"] == evaluations.NO_SQL


def test_sql_basic_evaluation(spark, facts, tmp_path):
    path = _sql_documents(
        tmp_path,
        [
            {"question_id": "a", "question": "q", "sql": "SELECT record_id FROM budget_outlays ORDER BY record_id"},
            {"question_id": "b", "question": "q"},
            {"question_id": "c", "question": "q", "sql": "SELECT broken FROM nowhere"},
            {"question_id": "d", "question": "q", "sql": "SELECT 1 WHERE false"},
        ],
        root="ground_truth_data",
    )
    samples = question_sets.sql_samples(question_sets.read_documents(spark, path))
    answers = _responses(
        spark,
        [
            ("a", "same", "SELECT record_id * 1.0 FROM budget_outlays ORDER BY 1", None, None),
            ("a", "copy", "SELECT record_id FROM budget_outlays ORDER BY record_id", None, None),
            ("a", "reversed", "SELECT record_id FROM budget_outlays ORDER BY record_id DESC", None, None),
            ("a", "short", "SELECT record_id FROM budget_outlays WHERE record_id < 3 ORDER BY 1", None, None),
            ("b", "runs", "SELECT 1", None, None),
            ("b", "fails", "SELECT x", None, None),
            ("c", "runs", "SELECT 1", None, None),
            ("d", "empty", "SELECT 2 WHERE 1 = 0", None, None),
        ],
    )
    got = {(r.sample_id, r.model): r.is_correct for r in evaluations.evaluate_sql_basic(samples, answers, facts).collect()}
    assert got == {
        ("a", "same"): True,
        ("a", "copy"): True,
        ("a", "reversed"): False,
        ("a", "short"): False,
        ("b", "runs"): True,
        ("b", "fails"): False,
        ("c", "runs"): False,
        ("d", "empty"): True,
    }


def test_statements_keep_row_order(spark, facts):
    facts["budget_outlays"].repartition(3).createOrReplaceTempView("budget_outlays")
    df = spark.createDataFrame([("SELECT record_id FROM budget_outlays ORDER BY record_id DESC",)], "sql string")
    status, rows = statement_runs.run_statements(df)
    assert [r.status for r in status.collect()] == ["ok"]
    assert [(r.pos, r.row_key) for r in rows.orderBy("pos").collect()] == [(1, ["3"]), (2, ["2"]), (3, ["1"])]


@pytest.mark.parametrize(
    "sql, status",
    [
        ("SELECT reflect('java.lang.Math', 'abs', 1)", "refused"),
        ("INSERT INTO t VALUES (1)", "refused"),
        ("SELECT `reflect`('java.lang.Math', 'abs', -1)", "refused"),
        ("SELECT 1 AS x WHERE EXISTS (SELECT java_method('java.lang.Math', 'abs', -1))", "refused"),
        ("SELECT TRANSFORM(1) USING 'cat' AS (a)", "refused"),
        ("SELECT * FROM text.`/etc/hostname`", "refused"),
        ("SELECT (SELECT max(value) FROM csv.`/etc/hostname`)", "refused"),
        ("WITH q AS (SELECT * FROM other_table) SELECT * FROM q", "execution_error"),
        ("SELECT (SELECT explode(array(1, 2)))", "execution_error"),
        ("SELECT (1", "dialect_error"),
        ("SELECT strftime('%Y', 'now')", "dialect_error"),
        ("SELECT * FROM no_such_table", "execution_error"),
        ("SELECT 1 AS a, 2 AS a", "ok"),
    ],
)
def test_statement_status(spark, sql, status):
    got, rows = statement_runs.run_statements(spark.createDataFrame([(sql,)], "sql string"))
    assert [r.status for r in got.collect()] == [status]
    if status == "ok":
        row = rows.first()
        # The last of two columns with one name stands for it, unless order matters.
        assert row.row_key == ["2"] and row.ordered_key == ["n:1", "n:2"]


def test_function_question_set_and_matching(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text(
        json.dumps(
            {
                "available_functions": [{"name": "f", "description": "d"}],
                "questions": [
                    {"question_id": 7, "question": "q", "function_sequence": [{"function_name": "f", "parameters": {"a": "1"}}]},
                    {"question": "none expected", "ground_truth_functions": []},
                ],
            }
        )
    )
    samples = question_sets.function_samples(question_sets.read_documents(spark, str(path)))
    assert sorted(r.sample_id for r in samples.collect()) == ["7", "func_1"]
    answers = _responses(
        spark,
        [
            ("7", "exact", "f(a=1)", None, None),
            ("7", "partly", "f(a=2)", None, None),
            ("7", "none", "no idea", None, None),
            ("func_1", "some", "f()", None, None),
            ("func_1", "none", "no idea", None, None),
        ],
    )
    got = {(r.sample_id, r.model): (r.is_correct, r.score) for r in evaluations.evaluate_calls_matching(samples, answers).collect()}
    assert got == {
        ("7", "exact"): (True, 1.0),
        ("7", "partly"): (False, 0.5),
        ("7", "none"): (False, 0.0),
        ("func_1", "some"): (True, 1.0),
        ("func_1", "none"): (False, 0.0),
    }


def test_catalogue_evaluation(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(
        json.dumps({"questions": [{"question": "q", "difficulty": 3, "expected_functions": [{"function_name": "get_gdp_by_industry", "parameters": {"year": 2016}}]}]})
    )
    samples = question_sets.catalogue_samples(question_sets.read_documents(spark, str(path)))
    row = samples.first()
    assert (row.sample_id, row.difficulty, row.category) == ("fcl_0", "medium", "discovery")
    answers = _responses(spark, [("fcl_0", "near", "get_gdp_by_industry(year=2017)", None, None), ("fcl_0", "off", "get_cpi_data()", None, None)])
    got = {r.model: (r.is_correct, round(r.score, 6)) for r in evaluations.evaluate_calls_catalogue(samples, answers).collect()}
    # Whole numbers one apart match under the lenient rule.
    assert got == {"near": (True, 0.96), "off": (False, 0.0)}


def test_executed_calls_and_reports(spark, facts, coverage, tmp_path):
    samples = spark.createDataFrame(
        [("f1", "How did CPI move?", "function", "easy"), ("f2", "Income by state?", "function", "hard"), ("s1", "Total?", "sql", "easy")],
        "sample_id string, question string, evaluation_type string, difficulty string",
    )
    answers = _responses(
        spark,
        [
            ("f1", "m", "get_cpi_data(series_id=cuur0000sa0, start_year=2015, end_year=2016)", 1.0, None),
            ("f2", "m", "get_regional_income(year=2023) get_productivity_data(start_year=abc)", 1.0, None),
            ("s1", "m", "SELECT SUM(outlay_amount) FROM budget_outlays", 1.0, None),
        ],
    )
    options = evaluations.RunOptions(order="sample_id", output_dir=str(tmp_path / "out"))
    out = evaluations.run_and_analyze(samples, answers, facts, coverage, options)
    got = {r.sample_id: r for r in out["results"].collect()}
    # The series id differs in case only: parameters match, but no fact has that key.
    assert (got["f1"].is_correct, got["f1"].score) == (True, 0.75)
    # One extra call: names differ, counts differ, half of the calls run and half find facts.
    assert (got["f2"].is_correct, got["f2"].score) == (False, 0.25)
    assert got["s1"].is_correct is True
    assert out["overall_metrics"].first().total_samples == 3
    assert {r.evaluation_type: r.accuracy for r in out["metrics_by_type"].collect()} == {"sql": 1.0, "function": 0.5}
    assert out["overall_metrics"].first().average_execution_time == 0.001
    # Component scores can be read back from stored results.
    parts = metrics.component_means(metrics.with_components(out["results"].where("evaluation_type = 'function'")), "model").first()
    assert (parts.mean_selection, parts.mean_execution, parts.mean_result) == (0.5, 0.75, 0.25)

    paths = out["saved_files"]
    stored = spark.read.json(paths["json_path"])
    assert stored.count() == 3 and set(sinks.RESULT_FIELDS) <= set(stored.columns)
    header = spark.read.option("header", True).csv(paths["csv_path"])
    assert [c for c in header.columns if c in sinks.CSV_FIELDS] == sinks.CSV_FIELDS
    report = "\n".join(r.value for r in spark.read.text(paths["report_path"]).collect())
    assert "| all | 3 |" in report and "| function |" in report


def test_run_options_choose_samples(spark):
    df = spark.createDataFrame(
        [(i, "sql" if i % 2 else "function", ["easy", "medium", "hard"][i % 3]) for i in range(12)],
        "pos int, evaluation_type string, difficulty string",
    )

    def pick(**options):
        return sorted(r.pos for r in evaluations.chosen_samples(df, evaluations.RunOptions(**options)).collect())

    assert pick() == list(range(12))
    assert pick(evaluation_type="sql", sql_samples=2) == [1, 3]
    assert pick(evaluation_type="function", difficulties=("hard",)) == [2, 8]
    assert pick(sql_samples=1, function_samples=0) == [1]
    assert pick(evaluation_type="full", sql_samples=1) == list(range(12))
    for bad in ({"evaluation_type": "other"}, {"sql_samples": -1}, {"difficulties": ("brutal",)}):
        with pytest.raises(ValueError):
            evaluations.RunOptions(**bad)


def test_prompt_tables(spark):
    samples = spark.createDataFrame(
        [("a", "Which state grew?", None, [("f", None)])],
        "sample_id string, question string, context string, available_functions array<struct<name string, description string>>",
    )
    for name in evaluations.EVALUATIONS:
        system, user = prompts.prompt_table(samples, name).first().messages
        assert (system.role, user.role) == ("system", "user") and "Which state grew?" in user.content
        if name == "sql":
            assert "TABLE: regional_data" in user.content
        if name == "calls_matching":
            assert "- f: No description" in user.content and prompts.NO_CONTEXT in user.content
        if name == "calls_catalogue":
            assert "get_regional_income(state, year, line_code=SA1-1)" in system.content


def test_calls_meet_the_facts(spark, coverage):
    """Repeated answers stay rows of their own, whatever they share."""
    texts = [
        "get_cpi_data(start_year=2015, end_year=2016) get_cpi_data(start_year=2017, end_year=2018)",
        "get_gdp_by_industry(year=2016) get_gdp_by_industry(year=2016, industry=SMALL) get_gdp_by_industry(year=2016, industry=LARGE)",
        "get_regional_income() get_regional_income(state=TX)",
        "get_gdp_by_industry(year=soon)",
        "nothing",
    ]
    rows = [*enumerate(texts), (0, texts[1]), (1, texts[1]), (4, texts[4])]
    df = spark.createDataFrame(rows, "i int, t string")
    df = with_requests(df.withColumn("predicted", extract_calls_labelled(F.col("t"))))
    want = [0.5, 2 / 3, 0.5, 0.0, 0.0]
    got = result_accuracy(df, coverage)
    assert got.columns == [*df.columns, "result"]
    assert sorted((r.i, r.t, round(r.result, 9)) for r in got.collect()) == sorted((i, t, round(want[texts.index(t)], 9)) for i, t in rows)


def test_answers_are_neither_sorted_nor_shuffled(spark, coverage):
    """Grouping whole answers held all of a task's answers in memory; rows that differ in a map only stay rows of their own."""
    texts = ["get_gdp_by_industry(year=2016)", "get_gdp_by_industry(year=2016) get_regional_income(state=TX)", "get_gdp_by_industry(year=1)", "get_gdp_by_industry(year=soon)", "nothing", None]
    want = dict(zip(texts, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame([(i, t) for t in texts for i in (1, 1, 2)], "i int, t string").withColumn("m", F.create_map(F.lit("i"), "i")).drop("i")
    df = with_requests(df.withColumn("predicted", extract_calls_labelled(F.col("t"))))
    expected = sorted(str((t, i, want[t])) for t in texts for i in (1, 1, 2))

    def answers(out):
        return sorted(str((r.t, r.m["i"], r.result)) for r in out.collect())

    looked_up = result_accuracy(df, coverage)
    assert answers(looked_up) == expected
    plan = looked_up._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert answers(result_accuracy(df, coverage)) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_results_report(spark):
    empty = spark.createDataFrame(
        [], "evaluation_type string, difficulty string, is_correct boolean, score double, execution_time double, error_message string"
    )
    assert evaluations.overall_metrics(empty).count() == 0
    assert sinks.render_report(empty).count("\n|") == 2


def test_responses_source(spark, tmp_path):
    rows = _responses(spark, [("a", "m", "text", 2.0, None), ("b", "m", "kept?", 2.0, "timeout")]).withColumn("run_id", F.lit("r"))
    rows.write.json(str(tmp_path / "r"))
    got = {r.sample_id: r for r in read_responses(spark, str(tmp_path / "r"), "json").collect()}
    assert got["a"].total_tokens == 15 and got["b"].content == ""


def test_selection_of_samples(spark):
    df = spark.range(10).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "easy").otherwise("hard").alias("difficulty")
    )
    pick = lambda d: sorted(r.pos for r in d.collect())
    assert pick(question_sets.filter_difficulty(df, [])) == list(range(10))
    assert pick(question_sets.first_samples(question_sets.filter_difficulty(df, ["hard"]), 2)) == [1, 3]
    assert pick(question_sets.first_samples(df, 0)) == list(range(10))
    assert pick(question_sets.first_samples(df, 1, per="difficulty")) == [0, 1]
    many = spark.range(4000).select(F.col("id").alias("pos"), (F.col("id") % 4 == 0).alias("kind"))
    assert pick(question_sets.first_samples(many, 1500, per="kind")) == sorted(
        [i for i in range(4000) if i % 4 == 0] + [i for i in range(4000) if i % 4][:1500]
    )
    both = question_sets.mixed_samples(df, df.withColumn("x", F.lit(1)), 0, 3)
    assert pick(both) == [0, 1, 2] and "x" in both.columns
    assert question_sets.mixed_samples(df, df, 0, 0).count() == 0


def test_statements_write_nothing(spark):
    """A statement that hides an insert is refused, and the others of its batch still run."""
    spark.sql("CREATE TABLE IF NOT EXISTS judged (x INT) USING parquet")
    spark.range(3).createOrReplaceTempView("numbers")
    statements = [
        ("WITH t AS (SELECT 7 AS x) INSERT INTO judged SELECT x FROM t",),
        ("SELECT count(*) AS n FROM numbers",),
        ("SELECT (SELECT id FROM numbers) AS x",),  # more than one row: fails while it runs
        ("SELECT max(id) AS m FROM numbers",),
        ("WITH q AS (SELECT 1 AS x), r AS (SELECT x + 4 AS y FROM q) SELECT r.y FROM r JOIN q ON y = x + 4",),
    ]
    status, rows = statement_runs.run_statements(spark.createDataFrame(statements, "sql string"), tables=["numbers"])
    got = {r.sql_id: r.status for r in status.collect()}
    ids = [r[0] for r in spark.createDataFrame(statements, "sql string").select(statement_runs.statement_id(F.col("sql"))).collect()]
    assert [got[i] for i in ids] == ["refused", "ok", "execution_error", "ok", "ok"]
    assert spark.table("judged").count() == 0
    assert {r.sql_id: list(r.row_key) for r in rows.collect()} == {ids[1]: ["3"], ids[3]: ["2"], ids[4]: ["5"]}
    spark.sql("DROP TABLE judged")


def test_basic_verdict_judges_the_raw_statement(spark):
    """Blanks and dashes inside literals count."""
    facts = {"budget_outlays": spark.createDataFrame([("a  b", 1), ("a b", 2), ("x--y", 3)], "function_name string, v int")}
    samples = [
        ("s1", "q", "sql", "easy", "SELECT v FROM budget_outlays WHERE function_name = 'a b'"),
        ("s2", "q", "sql", "easy", "SELECT v FROM budget_outlays WHERE function_name = 'x--y'"),
    ]
    samples = spark.createDataFrame(samples, "sample_id string, question string, evaluation_type string, difficulty string, ground_truth_sql string")
    answers = [
        ("r1", "m", "s1", "SELECT v FROM budget_outlays WHERE function_name = 'a  b'", ""),
        ("r2", "m", "s1", "SELECT v FROM budget_outlays WHERE function_name = 'a b'", None),
        ("r1", "m", "s2", "SELECT v FROM budget_outlays WHERE function_name = 'x--y'", ""),
    ]
    answers = spark.createDataFrame(answers, "run_id string, model string, sample_id string, content string, error string")
    answers = answers.withColumn("prompt_tokens", F.lit(1)).withColumn("completion_tokens", F.lit(1))
    got = evaluations.evaluate_sql_basic(samples, answers, facts).collect()
    assert {(r.run_id, r.sample_id): r.is_correct for r in got} == {("r1", "s1"): False, ("r2", "s1"): True, ("r1", "s2"): True}


def test_first_samples_of_any_kind(spark):
    """Null groups, text order and large counts all take one path."""
    rows = [("a", f"{i:05d}") for i in range(1500)] + [(None, "x"), (None, "y"), ("b", None), ("b", "z")]
    df = spark.createDataFrame(rows, "kind string, pos string")
    for n, want in ((1, 3), (2, 6), (1000, 1004), (1001, 1005), (2000, 1504)):
        assert question_sets.first_samples(df, n, per="kind").count() == want


def test_ids_over_several_documents(spark, tmp_path):
    """Made ids differ between files and lines; the first samples follow files, then places."""
    one = {"questions": [{"question": "q1"}, {"question": "q2"}]}
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(one))
    docs = question_sets.read_documents(spark, str(tmp_path))
    for samples in (question_sets.sql_samples, question_sets.function_samples, question_sets.catalogue_samples):
        ids = [r.sample_id for r in samples(docs).collect()]
        assert len(ids) == len(set(ids)) == 4
    placed = question_sets._items(docs, docs["doc"]["questions"])
    assert [(r.document, r.pos) for r in question_sets.first_samples(placed, 3).collect()] == [("a.json", 0), ("a.json", 1), ("b.json", 0)]
    single = question_sets.read_documents(spark, str(tmp_path / "a.json"))
    assert [r.sample_id for r in question_sets.sql_samples(single).collect()] == ["sql_0", "sql_1"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "l.json").write_text("\n".join([json.dumps(one)] * 3))
    lines = question_sets.read_documents(spark, str(tmp_path / "lines"), one_per_line=True)
    ids = [r.sample_id for r in question_sets.sql_samples(lines).collect()]
    assert len(ids) == len(set(ids)) == 6


def test_prompt_asks_for_the_form_that_is_read(spark):
    """An answer in the form that the executed-calls prompt shows is extracted as it stands."""
    form = prompts.SYSTEM_TEXT["labelled_function"].split("\n")
    assert form[1:3] == ["Function: name", "Parameters: key=value, key=value"]
    answer = "Function: get_cpi_data\nParameters: start_year=2015, end_year=2016"
    read = spark.createDataFrame([(answer,)], "t string").select(extract_calls_labelled(F.col("t"), True).alias("c"))
    (call,) = read.first().c
    assert call.name == "get_cpi_data"
    assert {a.key: a.sval for a in call.args} == {"start_year": "2015", "end_year": "2016"}


def test_missing_and_unknown_answers(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    rows = [("r1", "m", "a"), ("r1", "m", "b"), ("r2", "m", "a"), ("r3", "m", "zz")]
    answers = spark.createDataFrame([(*r, "x", 1, 1, None) for r in rows], "run_id string, model string, sample_id string, content string, prompt_tokens int, completion_tokens int, error string")
    got = evaluations.unanswered(samples, answers).collect()
    assert sorted((r.run_id, r.sample_id) for r in got) == [("r2", "b"), ("r3", "a"), ("r3", "b")]
    assert evaluations.unanswered(samples, answers.where("run_id = 'r1'")).count() == 0
    assert [r.sample_id for r in evaluations.unknown_answers(samples, answers).collect()] == ["zz"]


def test_schema_text_names_purpose_categories_and_a_query_that_runs(spark, facts):
    register_facts(facts)
    for table in FACT_COLUMNS:
        text = prompts.schema_of(table)
        assert prompts.HOLDS[table] in text and text.count("\n") == (4 if table in prompts.KEY_CATEGORIES else 3)
        if table in facts:
            spark.sql(prompts.sample_query(table)).collect()
