"""The registered queries: one per operator, over the whole test tables.

Each is ``(spark, sf_dir) -> DataFrame``. ``oracles`` holds SQL for the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import call_text, prompts, questions, sql_text
from tallywright.functions.values import lenient_match, strict_match
from tallywright.operators import call_execution, call_scores, confidence, economics, metrics, presence, returned_rows
from tallywright.operators import result_sets as rs
from tallywright.operators.positions import dense_positions
from tallywright.operators.statement_runs import run_statements, with_execution
from tallywright.plans import evaluations
from tallywright.plans.fixtures import table, view
from tallywright.session import scratch_dir
from tallywright.sources import question_sets, responses, run_store, sinks
from tallywright.sources.fact_tables import register_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _r(c: Column | str) -> Column:
    return F.round(c, DIGITS)


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "fx_samples")
    return df.withColumn("difficulty", questions.normal_difficulty(F.col("raw_difficulty")))


def _joined(items: Column) -> Column:
    return F.array_join(items, ",")


def call_rows(df: DataFrame, keys: list[str], calls: str) -> DataFrame:
    """One row per argument; calls without arguments and rows without calls keep one row."""
    out = df.select(*keys, F.posexplode_outer(calls).alias("call_pos", "call"))
    out = out.select(*keys, "call_pos", F.col("call.name").alias("name"), F.explode_outer("call.args").alias("a"))
    return out.select(
        *keys,
        "call_pos",
        "name",
        F.col("a.key").alias("arg_key"),
        F.col("a.kind").alias("arg_kind"),
        F.col("a.sval").alias("arg_text"),
    )


# Sources


@query("s1_sql_question_set")
def _(spark, sf):
    docs = question_sets.parse_documents(view(spark, sf, "fx_sql_documents", wide=True), "body")
    return question_sets.sql_samples(docs).select(
        "doc_id", "pos", "sample_id", "question", "difficulty", "context", "ground_truth_sql", "category", "complexity"
    )


@query("s2_function_question_set")
def _(spark, sf):
    docs = question_sets.parse_documents(view(spark, sf, "fx_function_documents", wide=True), "body")
    df = question_sets.function_samples(docs).withColumn(
        "tools", prompts.function_list(F.col("available_functions"))
    )
    keys = ["doc_id", "sample_id", "question", "difficulty", "category", "workflow_type", "tools"]
    return call_rows(df, keys, "expected_calls")


@query("s3_catalogue_question_set")
def _(spark, sf):
    docs = question_sets.parse_documents(view(spark, sf, "fx_catalogue_documents", wide=True), "body")
    df = question_sets.catalogue_samples(docs)
    return call_rows(df, ["doc_id", "sample_id", "question", "difficulty", "category", "context"], "expected_calls")


@query("s4_difficulty_filter")
def _(spark, sf):
    kept = question_sets.filter_difficulty(_samples(spark, sf), ["easy", "hard"])
    return kept.select("sample_id", "evaluation_type", "difficulty")


@query("s5_first_samples")
def _(spark, sf):
    kept = question_sets.filter_difficulty(_samples(spark, sf), ["medium"])
    return question_sets.first_samples(kept, 25, order="sample_id").select("sample_id", "difficulty")


@query("s5_first_samples_per_type")
def _(spark, sf):
    kept = question_sets.filter_difficulty(_samples(spark, sf), ["easy", "medium"])
    first = question_sets.first_samples(kept, 40, order="sample_id", per="evaluation_type")
    return first.select("sample_id", "evaluation_type", "difficulty")


@query("s6_mixed_samples")
def _(spark, sf):
    df = _samples(spark, sf).select("sample_id", "question", "evaluation_type", "difficulty")
    sql, function = [df.where(F.col("evaluation_type") == t) for t in ("sql", "function")]
    function = function.withColumn("expected_name", questions.expected_calls(F.col("question"))[0]["name"])
    return question_sets.mixed_samples(sql, function, None, 60, ["hard", "medium"], order="sample_id")


@query("s7_dataset_info")
def _(spark, sf):
    def read(name: str, kind: str, normalise) -> DataFrame:
        docs = question_sets.parse_documents(view(spark, sf, name, wide=True), "body")
        return normalise(docs).select(F.lit(kind).alias("set_name"))

    parts = [
        read("fx_sql_documents", "sql", question_sets.sql_samples),
        read("fx_function_documents", "function", question_sets.function_samples),
        read("fx_catalogue_documents", "function_eval", question_sets.catalogue_samples),
    ]
    return question_sets.dataset_info(reduce(lambda a, b: a.unionByName(b), parts), "set_name")


@query("s8_fact_scan")
def _(spark, sf):
    register_facts({"time_series_data": view(spark, sf, "fx_time_series_data")})
    return spark.sql(
        "SELECT category, year, COUNT(*) AS n, CAST(SUM(CAST(numeric_value AS DECIMAL(18,2))) AS DOUBLE) AS total "
        "FROM time_series_data WHERE is_estimated GROUP BY category, year"
    )


@query("s9_recorded_responses")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True).withColumn(
        "error", F.when(F.col("content").contains("do not know"), "refused")
    )
    out = responses.normalise_responses(df)
    return out.select("sample_id", "model", F.length("content").cast("bigint").alias("n_chars"), "total_tokens", "error")


def _stored_results(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "fx_eval_results")
    return df.withColumns(
        {
            "question": F.concat(F.lit("q, \""), F.col("difficulty"), F.lit('"')),
            "model_response": F.concat(F.lit("r"), F.col("sample_id")),
            "validation_details": F.concat(F.lit('{"n": '), F.col("sample_id"), F.lit("}")),
        }
    )


@query("s10_results_json")
def _(spark, sf):
    path = scratch_dir(spark, "results-json")
    sinks.write_results_json(_stored_results(spark, sf), path)
    schema = (
        "run_id string, model string, sample_id bigint, question string, evaluation_type string, difficulty string, "
        "model_response string, is_correct boolean, score double, execution_time double, error_message string, "
        "validation_details string, timestamp string"
    )
    return spark.read.schema(schema).json(path).withColumns({"score": _r("score"), "execution_time": _r("execution_time")})


@query("s11_results_csv")
def _(spark, sf):
    path = scratch_dir(spark, "results-csv")
    sinks.write_results_csv(_stored_results(spark, sf), path)
    schema = (
        "run_id string, model string, sample_id bigint, question string, evaluation_type string, difficulty string, "
        "model_response string, is_correct boolean, score double, execution_time double, error_message string, timestamp string"
    )
    stored = spark.read.schema(schema).csv(path, header=True, escape="\\")
    return stored.withColumns({"score": _r("score"), "execution_time": _r("execution_time")})


@query("s12_report")
def _(spark, sf):
    path = scratch_dir(spark, "report")
    sinks.write_report(view(spark, sf, "fx_eval_results"), path)
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith("Written ") & (F.col("value") != "")).select(
        F.col("value").alias("line")
    )


@query("s13_stored_runs")
def _(spark, sf):
    path = _saved_runs(spark, sf)
    return metrics.pass_summary(run_store.read_runs(spark, path, ["baseline", "improved"]), "run_id")


def _saved_runs(spark: SparkSession, sf: str) -> str:
    """Both runs as ``save_results`` stores them; one of them is then written again, and a third write is not finished."""
    results = view(spark, sf, "fx_eval_results")
    path = sinks.save_results(results, scratch_dir(spark, "runs"))["runs_path"]
    improved = results.where("run_id = 'improved'")
    run_store.write_run(improved, path)
    run_store.stage_run(improved.withColumn("is_correct", F.lit(True)), path)
    return path


@query("s13_store_metrics")
def _(spark, sf):
    """All metrics of stored runs, from the cells of their commits alone."""
    cells = run_store.committed_cells(spark, _saved_runs(spark, sf))
    return metrics.metrics_of_cells(cells, ["run_id", "model"])


# Questions


@query("p1_classify_question")
def _(spark, sf):
    df = view(spark, sf, "fx_samples")
    return df.select("sample_id", _joined(questions.classify_question(F.col("question"))).alias("tables"))


@query("p1_classify_documents")
def _(spark, sf):
    df = table(spark, sf, "documents", wide=True)
    return df.select("doc_id", _joined(questions.classify_question(F.col("text"))).alias("tables"))


@query("p2_classify_question_extended")
def _(spark, sf):
    df = view(spark, sf, "fx_samples")
    return df.select("sample_id", _joined(questions.classify_question_extended(F.col("question"))).alias("tables"))


@query("p2_classify_conversations")
def _(spark, sf):
    df = table(spark, sf, "conversations", wide=True)
    tables = _joined(questions.classify_question_extended(F.col("text")))
    return df.select("conv_id", "turn", "role", tables.alias("tables"))


@query("p3_expected_call")
def _(spark, sf):
    df = view(spark, sf, "fx_samples").withColumn("calls", questions.expected_calls(F.col("question")))
    return call_rows(df, ["sample_id"], "calls")


@query("p4_schema_text")
def _(spark, sf):
    df = view(spark, sf, "fx_samples")
    text = prompts.schema_text(questions.classify_question(F.col("question")))
    return df.select("sample_id", text.alias("schema_text"))


@query("p5_prompts")
def _(spark, sf):
    df = view(spark, sf, "fx_samples").withColumn(
        "context", F.when(F.col("raw_difficulty") == "HARD", F.concat(F.lit("about "), F.col("evaluation_type")))
    )
    q, c = F.col("question"), F.col("context")
    tools = F.array(
        F.struct(F.lit("f").alias("name"), F.lit("d").alias("description")),
        F.struct(F.lit("g").alias("name"), F.lit(None).cast("string").alias("description")),
    )
    schema = prompts.schema_text(questions.classify_question(q))
    kinds = {
        "sql": prompts.sql_prompt(q, c),
        "schema_sql": prompts.schema_sql_prompt(q, schema),
        "targeted_sql": prompts.schema_sql_prompt(q, schema, "targeted_sql"),
        "function": prompts.function_prompt(q, tools, c),
        "catalogue": prompts.catalogue_prompt(q, "f()"),
        "wrapped": prompts.messages(F.lit("s"), q, c),
    }
    one = [
        F.struct(F.lit(k).alias("kind"), m.alias("messages")) for k, m in kinds.items()
    ]
    rows = df.select("sample_id", F.inline(F.array(*one)))
    return rows.select("sample_id", "kind", F.inline("messages")).withColumn("n_chars", F.length("content").cast("bigint"))


@query("p6_year_limit")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True)
    return df.select("sample_id", questions.respects_year_limit(F.col("content")).alias("respects_limit"))


# Extraction


@query("x1_extract_sql_basic")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True)
    return df.select("sample_id", sql_text.extract_sql_basic(F.col("content")).alias("sql"))


@query("x2_extract_sql_block")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True)
    return df.select("sample_id", sql_text.extract_sql_block(F.col("content")).alias("sql"))


@query("x3_extract_sql_block_first_line")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True)
    sql = sql_text.extract_sql_block(F.col("content"), first_line_semicolon=True)
    return df.select("sample_id", sql.alias("sql"))


@query("x4_clean_sql")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True)
    return df.select("sample_id", sql_text.clean_sql(F.col("content")).alias("sql"))


@query("x5_statement_kind")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True).withColumn("sql", sql_text.extract_sql_basic(F.col("content")))
    return df.select("sample_id", sql_text.statement_kind(F.col("sql")).alias("kind"))


@query("x6_table_audit")
def _(spark, sf):
    df = view(spark, sf, "fx_sql_responses", wide=True).withColumn("sql", sql_text.extract_sql_block(F.col("content")))
    audited = df.withColumn("table_use", sql_text.table_audit(F.col("sql")))
    return audited.groupBy("model", "table_use").agg(F.count("*").alias("n"))


def _extracted(spark: SparkSession, sf: str, extract) -> DataFrame:
    df = view(spark, sf, "fx_call_responses", wide=True)
    return call_rows(df.withColumn("calls", extract(F.col("content"))), ["sample_id"], "calls")


@query("x7_calls_json_and_text")
def _(spark, sf):
    return _extracted(spark, sf, call_text.extract_calls_json_and_text)


@query("x8_calls_tiered")
def _(spark, sf):
    return _extracted(spark, sf, call_text.extract_calls_tiered)


@query("x9_calls_labelled")
def _(spark, sf):
    return _extracted(spark, sf, call_text.extract_calls_labelled)


def _parameters(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "fx_call_responses", wide=True)
    args = call_text.parse_labelled_parameters(F.col("content"))
    return df.select("sample_id", F.explode(args).alias("a")).select("sample_id", "a.*")


@query("x10_parameters")
def _(spark, sf):
    return _parameters(spark, sf).select("sample_id", F.col("key").alias("arg_key"), F.col("sval").alias("arg_text"))


@query("x11_typed_parameters")
def _(spark, sf):
    return _parameters(spark, sf).select(
        "sample_id", F.col("key").alias("arg_key"), F.col("kind").alias("arg_kind"), _r("nval").alias("arg_number")
    )


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "fx_call_responses", wide=True)
    return df.select("sample_id", "model", call_text.extract_calls_labelled(F.col("content")).alias("predicted"))


@query("x12_default_parameters")
def _(spark, sf):
    df = _labelled(spark, sf).withColumn(
        "calls",
        F.transform(
            "predicted",
            lambda c: F.struct(c["name"].alias("name"), call_text.with_defaults(c).alias("args")),
        ),
    )
    return call_rows(df, ["sample_id"], "calls")


@query("x13_well_formed")
def _(spark, sf):
    df = view(spark, sf, "fx_call_lists", wide=True).withColumn("calls", call_text.calls_from_json(F.col("predicted")))
    return df.select("sample_id", F.posexplode("calls").alias("call_pos", "call")).select(
        "sample_id", "call_pos", call_text.well_formed(F.col("call")).alias("is_well_formed")
    )


# Result sets


def _two_results(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [view(spark, sf, n) for n in ("fx_candidate_rows", "fx_expected_rows")]


def _keyed(df: DataFrame, key) -> DataFrame:
    return df.withColumn("row_key", key(df, ["v1", "v2", "v3"]))


def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    candidate, expected = [_keyed(df, rs.unordered_row_key) for df in _two_results(spark, sf)]
    return rs.result_similarity(candidate, expected, ["sample_id"])


def _equality(spark: SparkSession, sf: str) -> DataFrame:
    # Rows are numbered while they are narrow; keys are made afterwards.
    placed = [
        dense_positions(df, ["sample_id"], "place", ties=["v1", "v2", "v3"])
        for df in _two_results(spark, sf)
    ]
    candidate, expected = [_keyed(df, rs.ordered_row_key) for df in placed]
    return rs.ordered_equality(candidate, expected, ["sample_id"])


@query("m1_execution")
def _(spark, sf):
    register_facts({"budget_outlays": view(spark, sf, "fx_budget_outlays")})
    answers = view(spark, sf, "fx_sql_responses", wide=True).select(
        "sample_id", "model", sql_text.extract_sql_block(F.col("content")).alias("sql")
    )
    status, _rows = run_statements(answers)
    ran = with_execution(answers, status)
    return ran.select(
        "sample_id", "model", "executed", F.col("executed").cast("double").alias("execution_score")
    )


@query("m1_statement_rows")
def _(spark, sf):
    register_facts({"budget_outlays": view(spark, sf, "fx_budget_outlays")})
    answers = view(spark, sf, "fx_sql_responses", wide=True).select(sql_text.extract_sql_block(F.col("content")).alias("sql"))
    _status, rows = run_statements(answers)
    return rows.groupBy("sql_id").agg(F.count("*").alias("n_rows"), F.max("pos").alias("last_pos"))


@query("m1_same_meaning")
def _(spark, sf):
    """Statements that differ in blanks, case of words and aliases run once, per year of the data."""
    register_facts({"budget_outlays": view(spark, sf, "fx_budget_outlays")})
    years = view(spark, sf, "fx_budget_outlays").select("fiscal_year").distinct()
    forms = [
        ("count", "SELECT count(*) AS n FROM budget_outlays WHERE fiscal_year = "),
        ("count", "select  COUNT(*)  AS total from budget_outlays where fiscal_year = "),
        ("count", "SELECT count(*) FROM budget_outlays b WHERE b.fiscal_year = "),
        ("sum", "SELECT sum(outlay_amount) AS n FROM budget_outlays WHERE fiscal_year = "),
        ("broken", "SELECT none FROM budget_outlays WHERE fiscal_year = "),
        ("broken", "SELECT  none  FROM nowhere WHERE fiscal_year = "),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in forms])).alias("form")
    asked = years.select("fiscal_year", each).select("fiscal_year", "form.kind", F.concat("form.text", F.col("fiscal_year").cast("string")).alias("sql"))
    status, rows = run_statements(asked, tables=["budget_outlays"], by_meaning=True, numbered=False)
    results = rows.groupBy(F.col("sql_id").alias("result_id")).agg(F.first("row_key").alias("row_key"))
    told = with_execution(asked, status).join(results, "result_id", "left")
    value = F.when(F.col("kind") == "count", F.get("row_key", F.lit(0)))
    return told.groupBy("fiscal_year", "kind").agg(
        F.count(F.lit(1)).alias("texts"), F.count_distinct("result_id").alias("runs"), F.count_if("executed").alias("executed"), F.max(value).alias("value")
    )


@query("m2_ordered_equality")
def _(spark, sf):
    return _equality(spark, sf)


@query("m3_result_similarity")
def _(spark, sf):
    return _similarity(spark, sf).withColumn("similarity", _r("similarity"))


@query("m4_result_gate")
def _(spark, sf):
    df = _similarity(spark, sf)
    return df.select("sample_id", rs.passes_result(F.col("similarity")).alias("passes"))


@query("m5_binary_verdict")
def _(spark, sf):
    df = _similarity(spark, sf).withColumn("ran", F.col("sample_id") % 13 != 4)
    verdict = rs.sql_verdict(F.col("ran"), F.col("expected_rows") > 0, F.col("similarity"))
    out = df.withColumns(verdict)
    return out.select("sample_id", "execution_score", _r("result_score").alias("result_score"), "is_correct", _r("score").alias("score"))


@query("m6_database_verdict")
def _(spark, sf):
    df = _equality(spark, sf)
    i = F.col("sample_id")
    verdict = rs.database_verdict(i % 17 != 1, i % 13 != 4, i % 11 != 5, i % 7 != 2, F.col("is_equal"))
    return df.select("sample_id", verdict.alias("is_correct"))


# Calls


def _call_lists(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "fx_call_lists", wide=True)
    return df.select(
        "sample_id",
        "model",
        call_text.calls_from_json(F.col("predicted")).alias("predicted"),
        call_text.calls_from_json(F.col("expected")).alias("expected"),
    )


def _score(spark: SparkSession, sf: str, score) -> DataFrame:
    df = _call_lists(spark, sf)
    return df.select("sample_id", _r(score(F.col("predicted"), F.col("expected"))).alias("score"))


@query("m7_call_exact_match")
def _(spark, sf):
    df = call_scores.call_match(_call_lists(spark, sf))
    return df.select("sample_id", "is_exact", _r("match_score").alias("match_score"))


@query("m8_call_partial_score")
def _(spark, sf):
    df = call_scores.call_match(_call_lists(spark, sf))
    return df.select("sample_id", _r("partial_score").alias("partial_score"))


@query("m9_selection_exact")
def _(spark, sf):
    return _score(spark, sf, call_scores.selection_exact)


@query("m10_selection_f1")
def _(spark, sf):
    return _score(spark, sf, call_scores.selection_f1)


@query("m11_parameters_strict")
def _(spark, sf):
    return _score(spark, sf, call_scores.parameters_strict)


@query("m12_parameters_lenient")
def _(spark, sf):
    return _score(spark, sf, call_scores.parameters_lenient)


def _matches(spark: SparkSession, sf: str, rule) -> DataFrame:
    """Every expected argument against that of the same key in the call at the same place; false without one."""
    df = _call_lists(spark, sf)
    calls = F.explode(F.arrays_zip(F.col("expected").alias("e"), F.col("predicted").alias("p")))
    both = df.select("sample_id", calls.alias("z")).select("sample_id", "z.e.name", "z.e.args", F.col("z.p.args").alias("other"))
    args = both.select("sample_id", "name", F.explode("args").alias("a"), "other")
    found = args.withColumn("b", F.get(F.filter("other", lambda b: b["key"] == F.col("a.key")), F.lit(0)))
    match = F.coalesce(rule(F.col("a"), F.col("b")), F.lit(False))
    return found.select("sample_id", "name", F.col("a.key").alias("arg_key"), match.alias("is_match"))


@query("m13_strict_value_match")
def _(spark, sf):
    return _matches(spark, sf, strict_match)


@query("m14_lenient_value_match")
def _(spark, sf):
    return _matches(spark, sf, lenient_match)


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return call_execution.fact_coverage(
        view(spark, sf, "fx_time_series_data"), view(spark, sf, "fx_industry_gdp"), view(spark, sf, "fx_regional_data")
    )


@query("m15_execution_success")
def _(spark, sf):
    df = call_execution.with_requests(_labelled(spark, sf))
    return df.select("sample_id", _r(call_execution.execution_success(F.col("requests"))).alias("execution"))


@query("m16_result_accuracy")
def _(spark, sf):
    df = call_execution.with_requests(_labelled(spark, sf)).select("sample_id", "requests")
    out = call_execution.result_accuracy(df, _coverage(spark, sf))
    return out.select("sample_id", _r("result").alias("result"))


@query("m16_call_rows")
def _(spark, sf):
    points = returned_rows.fact_points(
        view(spark, sf, "fx_series_points"), view(spark, sf, "fx_industry_gdp"), view(spark, sf, "fx_regional_data")
    )
    # Small bins and parts, so that spans are cut and parts are visited at every scale.
    return returned_rows.returned_rows(returned_rows.asked_spans(_labelled(spark, sf), ["sample_id"]), points, width=3, hot=20)


@query("m17_well_formed_share")
def _(spark, sf):
    return _score(spark, sf, lambda p, e: call_scores.well_formed_share(p))


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return call_scores.catalogue_scores(_call_lists(spark, sf))


@query("m18_result_proxy")
def _(spark, sf):
    return _catalogue(spark, sf).select("sample_id", _r("result").alias("result"))


def _executed(spark: SparkSession, sf: str) -> DataFrame:
    """Answers about each event, put to the question of the same number."""
    samples = _call_samples(spark, sf)
    answers = view(spark, sf, "fx_call_responses", wide=True).withColumn(
        "error", F.when(F.col("content") == "No function fits.", "timeout")
    ).withColumns({"prompt_tokens": F.lit(1).cast("bigint"), "completion_tokens": F.lit(1).cast("bigint")})
    return evaluations.evaluate_calls_executed(samples, answers, _coverage(spark, sf))


def _call_samples(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    text = (
        F.when(F.col("event_type") == "click", "How did CPI move?")
        .when(F.col("event_type") == "view", "Which industry led GDP?")
        .when(F.col("event_type") == "purchase", "What is income by state?")
        .when(F.col("event_type") == "signup", "Name a specific value")
        .otherwise("Anything else")
    )
    return events.select(
        F.col("event_id").alias("sample_id"),
        text.alias("question"),
        F.lit("function").alias("evaluation_type"),
        F.when(F.col("value") < 20, "easy").when(F.col("value") < 60, "medium").otherwise("hard").alias("difficulty"),
    )


@query("m19_mean_verdict")
def _(spark, sf):
    df = _executed(spark, sf)
    return df.select("sample_id", "model", "is_correct", _r("score").alias("score"))


@query("m20_weighted_verdict")
def _(spark, sf):
    return _catalogue(spark, sf).select("sample_id", "is_correct", _r("score").alias("score"))


@query("m21_error_rows")
def _(spark, sf):
    df = _executed(spark, sf)
    return df.groupBy("error_message").agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("correct"), F.max("score").alias("max_score")
    ).where("error_message IS NOT NULL")


# Aggregation


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_eval_results")


@query("a1_overall_metrics")
def _(spark, sf):
    return metrics.overall_metrics(_results(spark, sf))


@query("a2_metrics_by_type")
def _(spark, sf):
    return metrics.metrics_by(_results(spark, sf), "evaluation_type")


@query("a3_metrics_by_difficulty")
def _(spark, sf):
    return metrics.metrics_by(_results(spark, sf), "difficulty")


@query("a4_detailed_breakdown")
def _(spark, sf):
    return metrics.detailed_breakdown(_results(spark, sf))


@query("a5_all_metrics")
def _(spark, sf):
    return metrics.all_metrics(_results(spark, sf))


@query("a5_all_metrics_by_model")
def _(spark, sf):
    return metrics.all_metrics(_results(spark, sf), by=["run_id", "model"])


@query("a6_error_rates")
def _(spark, sf):
    return metrics.error_rates(_results(spark, sf))


@query("a6_error_patterns")
def _(spark, sf):
    return metrics.error_patterns(_results(spark, sf))


@query("a6_top_error_patterns")
def _(spark, sf):
    return metrics.top_error_patterns(_results(spark, sf), 2)


@query("a7_pass_summary")
def _(spark, sf):
    return metrics.family_pass_summary(_results(spark, sf))


@query("a8_run_comparison")
def _(spark, sf):
    return metrics.compare_runs(_results(spark, sf), "baseline", "improved")


@query("a9_token_usage")
def _(spark, sf):
    return metrics.token_usage(view(spark, sf, "fx_sql_responses"), "model")


@query("a10_component_means")
def _(spark, sf):
    return metrics.component_means(_catalogue(spark, sf), "model")


@query("a11_model_comparison")
def _(spark, sf):
    # Samples are event types within a day here, so that several models share them.
    df = _results(spark, sf).withColumn(
        "sample_id", F.concat_ws("|", "evaluation_type", "difficulty", F.date_format("timestamp", "yyyy-MM-dd"))
    )
    return metrics.model_comparison(df)


@query("a11_pairwise_models")
def _(spark, sf):
    df = _results(spark, sf).withColumn("sample_id", F.concat_ws("|", "evaluation_type", "difficulty", F.hour("timestamp"), F.minute("timestamp")))
    return presence.pairwise_models(df)


def _with_gaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Samples, and answers of two runs that lack some of them."""
    samples = view(spark, sf, "fx_eval_results").select("sample_id", F.lit("q").alias("question"), "evaluation_type", "difficulty")
    answers = view(spark, sf, "fx_eval_results").where("sample_id % 10 <> 3").select(
        F.when(F.col("sample_id") % 7 == 0, "short").otherwise("long").alias("run_id"),
        F.lit("m").alias("model"),
        "sample_id",
        F.lit("x").alias("content"),
        F.when(F.col("sample_id") % 21 == 0, "timeout").alias("error"),
        F.lit(0).alias("prompt_tokens"),
        F.lit(0).alias("completion_tokens"),
    )
    return samples, answers


@query("m21_missing_answers")
def _(spark, sf):
    samples, answers = _with_gaps(spark, sf)
    return evaluations.missing_results(samples, answers).select("run_id", "sample_id", "evaluation_type", "is_correct", "score", "error_message")


@query("a1_metrics_with_missing")
def _(spark, sf):
    samples, answers = _with_gaps(spark, sf)
    given = evaluations.answered(samples, answers)
    given = evaluations.result_row(given, F.col("sample_id") % 2 == 0, F.lit(0.5), F.struct("content"))
    return metrics.all_metrics(given.unionByName(evaluations.missing_results(samples, answers)), by=["run_id"])


@query("a12_evaluation_types")
def _(spark, sf):
    df = _results(spark, sf)
    parts = [
        metrics.of_evaluation_type(df, t).agg(
            F.lit(t).alias("covers"), F.count("*").alias("n"), F.count_if("is_correct").alias("correct")
        )
        for t in metrics.EVALUATION_TYPES
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# Data access


@query("g1_cpi_data")
def _(spark, sf):
    return economics.get_cpi_data(view(spark, sf, "fx_time_series_data"), start_year=2015, end_year=2018).select(
        "record_id", "series_id", "year", "period_value", "numeric_value"
    )


@query("g2_employment_cost_index")
def _(spark, sf):
    return economics.get_employment_cost_index(view(spark, sf, "fx_time_series_data")).select(
        "record_id", "series_id", "year", "period_value", "numeric_value"
    )


@query("g3_productivity_data")
def _(spark, sf):
    return economics.get_productivity_data(
        view(spark, sf, "fx_time_series_data"), start_year=2014, end_year=2016
    ).select("record_id", "series_id", "year", "period_value", "numeric_value")


@query("g4_gdp_by_industry")
def _(spark, sf):
    gdp = view(spark, sf, "fx_industry_gdp")
    every = economics.get_gdp_by_industry(gdp, year=2016).withColumn("asked", F.lit("ALL"))
    one = economics.get_gdp_by_industry(gdp, year=2017, industry="SMALL").withColumn("asked", F.lit("SMALL"))
    return every.unionByName(one).select("asked", "industry_name", "year", "gdp_value")


@query("g5_regional_income")
def _(spark, sf):
    regional = view(spark, sf, "fx_regional_data")
    parts = [
        economics.get_regional_income(regional, state="NATION_3", year=2016, line_code=c)
        for c in economics.LINE_CODES
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("g6_budget_outlays")
def _(spark, sf):
    budget = view(spark, sf, "fx_budget_outlays")
    df = economics.get_budget_outlays(budget, "2-HIGH", 2016, 1000.0, 200000.0)
    return df.select("record_id", "function_name", "fiscal_year", "outlay_amount")


@query("q1_top_functions")
def _(spark, sf):
    return economics.top_functions(view(spark, sf, "fx_budget_outlays"), 2016, 10)


@query("q2_category_values")
def _(spark, sf):
    return economics.category_values(view(spark, sf, "fx_time_series_data"), "consumer_price_index", 2015, 2017)


@query("q3_top_industries")
def _(spark, sf):
    return economics.top_of_year(view(spark, sf, "fx_industry_gdp"), 2016, "industry_name", "gdp_value", 10)


@query("q3_top_states")
def _(spark, sf):
    return economics.top_of_year(view(spark, sf, "fx_regional_data"), 2016, "state_name", "personal_income", 10)


@query("q4_contribution_totals")
def _(spark, sf):
    return economics.contribution_totals(view(spark, sf, "fx_gdp_by_industry"), 2016)


@query("q5_indicator_names")
def _(spark, sf):
    return economics.indicator_names(view(spark, sf, "fx_economic_indicators"), "BLS")


@query("q6_outlay_lookup")
def _(spark, sf):
    return economics.outlay_of(view(spark, sf, "fx_budget_outlays"), "1-URGENT", 2017)


@query("q7_top_per_year")
def _(spark, sf):
    return economics.top_per_year(view(spark, sf, "fx_budget_outlays"), 3)


@query("q8_row_count")
def _(spark, sf):
    return economics.row_count(view(spark, sf, "fx_budget_outlays"))


# Analytic functions


@query("d1_query_economic_data")
def _(spark, sf):
    df = view(spark, sf, "fx_time_series_data")
    parts = [
        economics.query_economic_data(df, "BLS", (2015, 2018), "CUUR0000SA0", "consumer_price_index", a).withColumn(
            "aggregation", F.lit(a)
        )
        for a in ("sum", "average", "min", "max", "count")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("d2_query_budget_data")
def _(spark, sf):
    df = view(spark, sf, "fx_budget_outlays")
    return economics.query_budget_data(df, "avg", None, None, (2015, 2018), 1000.0, 300000.0)


def _trends(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return economics.analyze_trends(
        view(spark, sf, "fx_budget_outlays"), kind, "function_name", "fiscal_year", "outlay_amount",
        (2014, 2020), ["1-URGENT", "2-HIGH", "5-LOW"],
    )


@query("d3_trend")
def _(spark, sf):
    return _trends(spark, sf, "trend")


@query("d3_forecast")
def _(spark, sf):
    return _trends(spark, sf, "forecast")


@query("d3_comparison")
def _(spark, sf):
    return _trends(spark, sf, "comparison")


@query("d3_correlation")
def _(spark, sf):
    return _trends(spark, sf, "correlation")


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    return confidence.domain_totals(view(spark, sf, "fx_budget_outlays"), view(spark, sf, "fx_time_series_data"), "combined", (2012, 2016))


@query("d3_combined_trend")
def _(spark, sf):
    return confidence.chosen_metrics(economics.trend_summary(_combined(spark, sf)), ["growth_rate", "volatility"])


@query("d3_combined_correlation")
def _(spark, sf):
    pairs = confidence.pair_correlations(_combined(spark, sf))
    return pairs.withColumn("correlation", _r("correlation"))


@query("d4_compare_efficiency")
def _(spark, sf):
    df = view(spark, sf, "fx_budget_outlays")
    return economics.compare_categories(
        df, "1-URGENT", "5-LOW", "function_name", "fiscal_year", "outlay_amount", (2014, 2020), "ratio", "efficiency"
    )


@query("d4_compare_categories")
def _(spark, sf):
    df = view(spark, sf, "fx_budget_outlays")
    parts = [
        economics.compare_categories(
            df, "1-URGENT", "5-LOW", "function_name", "fiscal_year", "outlay_amount", (2014, 2020), kind
        ).withColumn("comparison_type", F.lit(kind))
        for kind in economics.COMPARISONS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("d4_compare_growth")
def _(spark, sf):
    df = view(spark, sf, "fx_budget_outlays")
    return economics.compare_categories(
        df, "1-URGENT", "5-LOW", "function_name", "fiscal_year", "outlay_amount", (2014, 2020), "absolute", "growth"
    )


def _patterns(spark: SparkSession, sf: str, kind: str, horizon: str = "long_term", confidence: float = 0.95) -> DataFrame:
    df = view(spark, sf, "fx_time_series_data")
    return economics.identify_patterns(df, kind, ["BLS", "BEA", "OMB"], horizon, confidence)


@query("d5_seasonal")
def _(spark, sf):
    return _patterns(spark, sf, "seasonal")


@query("d5_anomaly")
def _(spark, sf):
    return _patterns(spark, sf, "anomaly", "medium_term", 0.9)


@query("d5_cyclical")
def _(spark, sf):
    return _patterns(spark, sf, "cyclical")


@query("d5_trend")
def _(spark, sf):
    return _patterns(spark, sf, "trend")


@query("d5_correlation")
def _(spark, sf):
    return _patterns(spark, sf, "correlation")


def _confident(spark: SparkSession, sf: str, kind: str, threshold: float) -> DataFrame:
    return confidence.confident_patterns(view(spark, sf, "fx_time_series_data"), kind, ["BLS", "BEA", "OMB"], "long_term", threshold)


@query("d5_confident_trend")
def _(spark, sf):
    return _confident(spark, sf, "trend", 0.1)


@query("d5_confident_correlation")
def _(spark, sf):
    return _confident(spark, sf, "correlation", 0.5)


@query("d5_confident_seasonal")
def _(spark, sf):
    return _confident(spark, sf, "seasonal", 0.05)


@query("d5_confident_cyclical")
def _(spark, sf):
    return _confident(spark, sf, "cyclical", 0.5)


# Whole evaluations


def _sql_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    samples = view(spark, sf, "fx_sql_samples").withColumn(
        "expected_result", F.from_json("expected", "array<map<string,variant>>")
    )
    facts = {"budget_outlays": view(spark, sf, "fx_budget_outlays")}
    return samples, view(spark, sf, "fx_sql_responses", wide=True), facts


@query("sql_evaluation")
def _(spark, sf):
    results = evaluations.evaluate_sql(*_sql_inputs(spark, sf))
    return results.select("sample_id", "model", "difficulty", "is_correct", _r("score").alias("score"))


@query("sql_basic_evaluation")
def _(spark, sf):
    results = evaluations.evaluate_sql_basic(*_sql_inputs(spark, sf))
    return results.select("sample_id", "model", "is_correct", "score")


@query("function_evaluation")
def _(spark, sf):
    """Answers to calls, calls to facts, scores to reports: the flagship query."""
    return metrics.all_metrics(_executed(spark, sf).drop("execution_time").withColumn("execution_time", F.lit(1.0)), by=["model"])
