"""SQL for the results of the registered queries, for the checking engine.

The statements recompute each result with plain relational SQL over the same adapter
views; they share no logic with the DataFrame code.
"""

from __future__ import annotations

from tallywright.functions import prompts
from tallywright.functions.call_text import FUNCTION_DEFAULTS
from tallywright.plans.fixtures import prelude
from tallywright.sources.fact_tables import FACT_COLUMNS

ORACLES: dict[str, str] = {}


def _add(name: str, body: str, *views: str, ctes: str = "") -> None:
    head = prelude(*views) if views else ""
    if ctes:
        head = f"{head},\n{ctes}" if head else f"WITH {ctes}"
    ORACLES[name] = f"{head}\n{body}".strip()


# Sources

_ITEMS = """docs AS (SELECT doc_id, body, coalesce(json_extract(body, '$.questions'), json_extract(body, '$.ground_truth_data')) AS q FROM {view}),
places AS (SELECT doc_id, body, q, CAST(unnest(range(CAST(json_array_length(q) AS BIGINT))) AS INT) AS pos FROM docs),
items AS (SELECT doc_id, body, pos, json_extract(q, '$[' || pos || ']') AS item FROM places)"""

_DIFFICULTY = """CASE WHEN lower({0}) IN ('easy', 'medium', 'hard') THEN lower({0}) ELSE 'medium' END"""
_ITEM_DIFFICULTY = (
    "CASE WHEN json_type(item, '$.difficulty') = 'VARCHAR' THEN "
    + _DIFFICULTY.format("json_extract_string(item, '$.difficulty')")
    + " ELSE 'medium' END"
)


def _str(key: str) -> str:
    return f"json_extract_string(item, '$.{key}')"


def _typed(value: str) -> str:
    """Kind and text of a JSON value, as the columns arg_kind and arg_text."""
    text = f"json_extract_string({value}, '$')"
    return f"""CASE json_type({value}) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
      WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'str' ELSE 'json' END AS arg_kind,
    CASE json_type({value}) WHEN 'DOUBLE' THEN CAST(CAST({text} AS DOUBLE) AS VARCHAR)
      WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 'True' ELSE 'False' END
      WHEN 'NULL' THEN 'None' ELSE {text} END AS arg_text"""


_add(
    "s1_sql_question_set",
    f"""SELECT doc_id, pos, coalesce({_str('question_id')}, 'sql_' || pos) AS sample_id,
  coalesce({_str('question_text')}, {_str('question')}, '') AS question, {_ITEM_DIFFICULTY} AS difficulty,
  {_str('context')} AS context, coalesce({_str('reference_sql')}, {_str('ground_truth_sql')}, {_str('sql')}, '') AS ground_truth_sql,
  {_str('category')} AS category, {_str('complexity')} AS complexity FROM items""",
    "fx_sql_documents",
    ctes=_ITEMS.format(view="fx_sql_documents"),
)


def _calls_of_items(calls: str, name: str, args: str) -> str:
    return f"""listed AS (SELECT *, {calls} AS calls FROM items),
call_places AS (SELECT doc_id, pos, calls, CAST(unnest(range(CAST(json_array_length(calls) AS BIGINT))) AS INT) AS call_pos FROM listed),
calls AS (SELECT doc_id, pos, call_pos, json_extract(calls, '$[' || call_pos || ']') AS c FROM call_places),
named AS (SELECT doc_id, pos, call_pos, {name} AS name, {args} AS a FROM calls),
arg_keys AS (SELECT doc_id, pos, call_pos, a, unnest(json_keys(a)) AS arg_key FROM named),
arg_values AS (SELECT doc_id, pos, call_pos, arg_key, json_extract(a, '$."' || arg_key || '"') AS v FROM arg_keys),
args AS (SELECT doc_id, pos, call_pos, arg_key, {_typed('v')} FROM arg_values)"""


_FROM_ITEMS = """FROM listed LEFT JOIN named USING (doc_id, pos) LEFT JOIN args USING (doc_id, pos, call_pos)"""

_add(
    "s2_function_question_set",
    f"""SELECT doc_id, coalesce({_str('question_id')}, 'func_' || pos) AS sample_id,
  coalesce({_str('question_text')}, {_str('question')}, '') AS question, {_ITEM_DIFFICULTY} AS difficulty,
  {_str('category')} AS category, {_str('workflow_type')} AS workflow_type,
  CASE WHEN json_type(body, '$.available_functions') IS NOT NULL THEN '- f: d'
       WHEN json_type(item, '$.available_functions') IS NOT NULL THEN '- g: No description' ELSE '' END AS tools,
  call_pos, name, arg_key, arg_kind, arg_text {_FROM_ITEMS}""",
    "fx_function_documents",
    ctes=_ITEMS.format(view="fx_function_documents")
    + ",\n"
    + _calls_of_items(
        "coalesce(json_extract(item, '$.function_sequence'), json_extract(item, '$.ground_truth_functions'))",
        "coalesce(json_extract_string(c, '$.function_name'), json_extract_string(c, '$.name'))",
        "coalesce(json_extract(c, '$.parameters'), json_extract(c, '$.arguments'))",
    ),
)
_add(
    "s3_catalogue_question_set",
    f"""SELECT doc_id, 'fcl_' || coalesce({_str('question_id')}, CAST(pos AS VARCHAR)) AS sample_id,
  coalesce({_str('question')}, '') AS question, {_ITEM_DIFFICULTY} AS difficulty,
  coalesce({_str('category')}, 'discovery') AS category, {_str('context')} AS context,
  call_pos, name, arg_key, arg_kind, arg_text {_FROM_ITEMS}""",
    "fx_catalogue_documents",
    ctes=_ITEMS.format(view="fx_catalogue_documents")
    + ",\n"
    + _calls_of_items(
        "json_extract(item, '$.expected_functions')",
        "json_extract_string(c, '$.function_name')",
        "json_extract(c, '$.parameters')",
    ),
)

_SAMPLES = f"samples AS (SELECT *, {_DIFFICULTY.format('raw_difficulty')} AS difficulty FROM fx_samples)"

_add(
    "s4_difficulty_filter",
    "SELECT sample_id, evaluation_type, difficulty FROM samples WHERE difficulty <> 'medium'",
    "fx_samples",
    ctes=_SAMPLES,
)
_add(
    "s5_first_samples",
    "SELECT sample_id, difficulty FROM samples WHERE difficulty = 'medium' ORDER BY sample_id LIMIT 25",
    "fx_samples",
    ctes=_SAMPLES,
)
_add(
    "s5_first_samples_per_type",
    """SELECT sample_id, evaluation_type, difficulty FROM samples WHERE difficulty <> 'hard'
QUALIFY row_number() OVER (PARTITION BY evaluation_type ORDER BY sample_id) <= 40""",
    "fx_samples",
    ctes=_SAMPLES,
)

_EXPECTED_NAME = """CASE WHEN q LIKE '%cpi%' OR q LIKE '%consumer price%' THEN 'get_cpi_data'
  WHEN q LIKE '%employment cost%' OR q LIKE '%eci%' THEN 'get_employment_cost_index'
  WHEN q LIKE '%gdp%' AND q LIKE '%industry%' THEN 'get_gdp_by_industry'
  WHEN q LIKE '%income%' AND (q LIKE '%state%' OR q LIKE '%region%') THEN 'get_regional_income'
  ELSE 'get_gdp_by_industry' END"""

_add(
    "s6_mixed_samples",
    f"""SELECT sample_id, question, evaluation_type, difficulty, NULL AS expected_name FROM samples
WHERE evaluation_type = 'sql' AND difficulty <> 'easy'
UNION ALL SELECT * FROM (SELECT sample_id, question, evaluation_type, difficulty, {_EXPECTED_NAME} AS expected_name
FROM (SELECT *, lower(question) AS q FROM samples) WHERE evaluation_type = 'function' AND difficulty <> 'easy'
ORDER BY sample_id LIMIT 60)""",
    "fx_samples",
    ctes=_SAMPLES,
)
_add(
    "s7_dataset_info",
    """SELECT set_name, CAST(sum(n) AS BIGINT) AS total_questions FROM (
SELECT 'sql' AS set_name, json_array_length(coalesce(json_extract(body, '$.questions'), json_extract(body, '$.ground_truth_data'))) AS n FROM fx_sql_documents
UNION ALL SELECT 'function', json_array_length(coalesce(json_extract(body, '$.questions'), json_extract(body, '$.ground_truth_data'))) FROM fx_function_documents
UNION ALL SELECT 'function_eval', json_array_length(json_extract(body, '$.questions')) FROM fx_catalogue_documents) GROUP BY 1""",
    "fx_sql_documents",
    "fx_function_documents",
    "fx_catalogue_documents",
)
_add(
    "s8_fact_scan",
    """SELECT category, year, COUNT(*) AS n, CAST(SUM(CAST(numeric_value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM fx_time_series_data WHERE is_estimated GROUP BY category, year""",
    "fx_time_series_data",
)
_add(
    "s9_recorded_responses",
    """SELECT sample_id, model, CAST(CASE WHEN content = 'I do not know.' THEN 0 ELSE length(content) END AS BIGINT) AS n_chars,
  prompt_tokens + completion_tokens AS total_tokens, CASE WHEN content = 'I do not know.' THEN 'refused' END AS error
FROM fx_sql_responses""",
    "fx_sql_responses",
)

_STORED = """run_id, model, sample_id, 'q, "' || difficulty || '"' AS question, evaluation_type, difficulty,
  'r' || sample_id AS model_response, is_correct, round(score, 6) AS score, round(execution_time, 6) AS execution_time, error_message,
  strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp"""
_add(
    "s10_results_json",
    f"""SELECT {_STORED}, '{{"n": ' || sample_id || '}}' AS validation_details FROM fx_eval_results""",
    "fx_eval_results",
)
_add("s11_results_csv", f"SELECT {_STORED} FROM fx_eval_results", "fx_eval_results")


# Aggregation

_METRICS = """COUNT(*) AS total_samples, COUNT(CASE WHEN is_correct THEN 1 END) AS correct_samples,
  round(COUNT(CASE WHEN is_correct THEN 1 END) / COUNT(*), 6) AS accuracy, round(avg(CAST(score AS DECIMAL(18,9))), 6) AS average_score,
  round(avg(CAST(execution_time AS DECIMAL(18,9))), 6) AS average_execution_time"""
_ERROR_RATE = "round(COUNT(error_message) / COUNT(*), 6) AS error_rate"
_LEVEL = """CASE WHEN grouping(evaluation_type) = 1 AND grouping(difficulty) = 1 THEN 'overall'
  WHEN grouping(difficulty) = 1 THEN 'type' WHEN grouping(evaluation_type) = 1 THEN 'difficulty' ELSE 'type_difficulty' END AS level"""

_add(
    "s12_report",
    """SELECT '# Evaluation' AS line
UNION ALL SELECT unnest(['| group | n | right | share right | mean score | mean seconds | share failed |', '|---|---|---|---|---|---|---|'])
UNION ALL SELECT printf('| %s | %d | %d | %.4f | %.4f | %.3f | %.4f |', k, n, c, acc, s, t, er) FROM m""",
    "fx_eval_results",
    ctes="""stacked AS (SELECT 'all' AS k, * FROM fx_eval_results UNION ALL SELECT evaluation_type, * FROM fx_eval_results UNION ALL SELECT difficulty, * FROM fx_eval_results),
m AS (SELECT k, COUNT(*) AS n, COUNT(CASE WHEN is_correct THEN 1 END) AS c, round(COUNT(CASE WHEN is_correct THEN 1 END) / COUNT(*), 6) AS acc, round(avg(CAST(score AS DECIMAL(18,9))), 6) AS s,
  round(avg(CAST(execution_time AS DECIMAL(18,9))), 6) AS t, round(COUNT(error_message) / COUNT(*), 6) AS er, COUNT(error_message) AS e FROM stacked GROUP BY k)""",
)
_add(
    "s13_stored_runs",
    """SELECT run_id, COUNT(*) AS total_samples, COUNT(CASE WHEN is_correct THEN 1 END) AS passed, COUNT(*) - COUNT(CASE WHEN is_correct THEN 1 END) AS failed,
  round(COUNT(CASE WHEN is_correct THEN 1 END) / COUNT(*), 6) AS success_rate, round(avg(CAST(score AS DECIMAL(18,9))), 6) AS average_score FROM fx_eval_results GROUP BY run_id""",
    "fx_eval_results",
)
_add("a1_overall_metrics", f"SELECT {_METRICS}, {_ERROR_RATE} FROM fx_eval_results", "fx_eval_results")
_add(
    "a2_metrics_by_type",
    f"SELECT evaluation_type, {_METRICS}, {_ERROR_RATE} FROM fx_eval_results GROUP BY evaluation_type",
    "fx_eval_results",
)
_add(
    "a3_metrics_by_difficulty",
    f"SELECT difficulty, {_METRICS}, {_ERROR_RATE} FROM fx_eval_results GROUP BY difficulty",
    "fx_eval_results",
)
_add(
    "a4_detailed_breakdown",
    f"SELECT evaluation_type, difficulty, {_METRICS} FROM fx_eval_results GROUP BY evaluation_type, difficulty",
    "fx_eval_results",
)
_add(
    "a5_all_metrics",
    f"""SELECT evaluation_type, difficulty, {_LEVEL}, {_METRICS}, {_ERROR_RATE} FROM fx_eval_results
GROUP BY GROUPING SETS ((), (evaluation_type), (difficulty), (evaluation_type, difficulty))""",
    "fx_eval_results",
)
_add(
    "a5_all_metrics_by_model",
    f"""SELECT run_id, model, evaluation_type, difficulty, {_LEVEL}, {_METRICS}, {_ERROR_RATE} FROM fx_eval_results
GROUP BY GROUPING SETS ((run_id, model), (run_id, model, evaluation_type), (run_id, model, difficulty), (run_id, model, evaluation_type, difficulty))""",
    "fx_eval_results",
)
_add(
    "a6_error_rates",
    f"SELECT evaluation_type, COUNT(error_message) AS total_errors, {_ERROR_RATE} FROM fx_eval_results GROUP BY 1",
    "fx_eval_results",
)
_PATTERNS = """patterns AS (SELECT evaluation_type, difficulty, error_message, COUNT(*) AS occurrences
FROM fx_eval_results WHERE error_message IS NOT NULL GROUP BY ALL)"""
_add("a6_error_patterns", "SELECT * FROM patterns", "fx_eval_results", ctes=_PATTERNS)
_add(
    "a6_top_error_patterns",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY evaluation_type, difficulty ORDER BY occurrences DESC, error_message) AS INT) AS rank
FROM patterns) WHERE rank <= 2""",
    "fx_eval_results",
    ctes=_PATTERNS,
)
_add(
    "a7_pass_summary",
    """SELECT COUNT(*) AS total_samples, COUNT(CASE WHEN is_correct THEN 1 END) AS passed, COUNT(*) - COUNT(CASE WHEN is_correct THEN 1 END) AS failed,
  round(COUNT(CASE WHEN is_correct THEN 1 END) / COUNT(*), 6) AS success_rate,
  round(avg(CAST(is_correct AS INT)) FILTER (evaluation_type = 'sql'), 6) AS sql_success_rate,
  round(avg(CAST(is_correct AS INT)) FILTER (evaluation_type = 'function'), 6) AS function_success_rate FROM fx_eval_results""",
    "fx_eval_results",
)
_add(
    "a8_run_comparison",
    """SELECT b.n AS baseline_total, i.n AS improved_total, b.p AS baseline_passed, i.p AS improved_passed,
  round(b.p / b.n, 6) AS baseline_success_rate, round(i.p / i.n, 6) AS improved_success_rate, round(i.p / i.n - b.p / b.n, 6) AS success_rate_change,
  round(b.s, 6) AS baseline_average_score, round(i.s, 6) AS improved_average_score, round(i.s - b.s, 6) AS average_score_change,
  i.p - b.p AS passed_change FROM runs b JOIN runs i ON b.run_id = 'baseline' AND i.run_id = 'improved'""",
    "fx_eval_results",
    ctes="runs AS (SELECT run_id, COUNT(*) AS n, COUNT(CASE WHEN is_correct THEN 1 END) AS p, avg(CAST(score AS DECIMAL(18,9))) AS s FROM fx_eval_results GROUP BY run_id)",
)
_add(
    "a9_token_usage",
    """SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM fx_sql_responses GROUP BY model""",
    "fx_sql_responses",
)
_add(
    "s13_store_metrics",
    """SELECT run_id, model, CASE WHEN GROUPING(evaluation_type) = 1 AND GROUPING(difficulty) = 1 THEN 'overall' WHEN GROUPING(difficulty) = 1 THEN 'type'
    WHEN GROUPING(evaluation_type) = 1 THEN 'difficulty' ELSE 'type_difficulty' END AS level, evaluation_type, difficulty,
  COUNT(*) AS total_samples, count_if(is_correct) AS correct_samples, round(count_if(is_correct) / COUNT(*), 6) AS accuracy,
  round(avg(CAST(score AS DECIMAL(18,9))), 6) AS average_score, round(avg(CAST(execution_time AS DECIMAL(18,9))), 6) AS average_execution_time,
  round(COUNT(error_message) / COUNT(*), 6) AS error_rate
FROM fx_eval_results GROUP BY GROUPING SETS ((run_id, model), (run_id, model, evaluation_type), (run_id, model, difficulty), (run_id, model, evaluation_type, difficulty))""",
    "fx_eval_results",
)
_add(
    "a11_pairwise_models",
    """, r AS (SELECT model, evaluation_type || '|' || difficulty || '|' || hour(timestamp) || '|' || minute(timestamp) AS sid, bool_and(is_correct) AS ok FROM fx_eval_results GROUP BY ALL)
SELECT a.model AS model_a, b.model AS model_b, COUNT(*) AS common_samples, count_if(a.ok AND b.ok) AS both_right, count_if(a.ok AND NOT b.ok) AS only_a_right,
  count_if(b.ok AND NOT a.ok) AS only_b_right, round((count_if(a.ok AND NOT b.ok) - count_if(b.ok AND NOT a.ok)) / COUNT(*), 6) AS lead_of_a
FROM r a JOIN r b ON a.sid = b.sid AND a.model < b.model GROUP BY 1, 2""",
    "fx_eval_results",
)
_GAPS = """runs AS (SELECT * FROM (VALUES ('short'), ('long')) v(run_id)),
given AS (SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN 'short' ELSE 'long' END AS run_id, sample_id % 21 = 0 AS failed FROM fx_eval_results WHERE sample_id % 10 <> 3),
every AS (SELECT runs.run_id, s.sample_id, s.evaluation_type, s.difficulty, g.failed, g.sample_id IS NULL AS missing
  FROM fx_eval_results s CROSS JOIN runs LEFT JOIN given g ON g.run_id = runs.run_id AND g.sample_id = s.sample_id)"""
_add(
    "m21_missing_answers",
    "SELECT run_id, sample_id, evaluation_type, false AS is_correct, 0.0::DOUBLE AS score, 'No answer recorded' AS error_message FROM every WHERE missing",
    "fx_eval_results",
    ctes=_GAPS,
)
_add(
    "a1_metrics_with_missing",
    """SELECT run_id, CASE WHEN GROUPING(evaluation_type) = 1 AND GROUPING(difficulty) = 1 THEN 'overall' WHEN GROUPING(difficulty) = 1 THEN 'type'
    WHEN GROUPING(evaluation_type) = 1 THEN 'difficulty' ELSE 'type_difficulty' END AS level, evaluation_type, difficulty,
  COUNT(*) AS total_samples, count_if(NOT wrong AND sample_id % 2 = 0) AS correct_samples, round(count_if(NOT wrong AND sample_id % 2 = 0) / COUNT(*), 6) AS accuracy,
  round(avg(CASE WHEN wrong THEN 0.0 ELSE 0.5 END), 6) AS average_score, NULL::DOUBLE AS average_execution_time, round(count_if(wrong) / COUNT(*), 6) AS error_rate
FROM (SELECT *, missing OR coalesce(failed, false) AS wrong FROM every)
GROUP BY GROUPING SETS ((run_id), (run_id, evaluation_type), (run_id, difficulty), (run_id, evaluation_type, difficulty))""",
    "fx_eval_results",
    ctes=_GAPS,
)
_add(
    "a11_model_comparison",
    """SELECT model, COUNT(DISTINCT sid) AS common_samples, COUNT(*) AS total_samples, COUNT(CASE WHEN is_correct THEN 1 END) AS correct_samples,
  round(avg(CAST(is_correct AS INT)), 6) AS accuracy, round(avg(CAST(score AS DECIMAL(18,9))), 6) AS average_score,
  CAST(rank() OVER (ORDER BY COUNT(CASE WHEN is_correct THEN 1 END) / COUNT(*) DESC) AS INT) AS rank
FROM r WHERE sid IN (SELECT sid FROM r GROUP BY sid HAVING COUNT(DISTINCT model) = (SELECT COUNT(DISTINCT model) FROM r)) GROUP BY model""",
    "fx_eval_results",
    ctes="r AS (SELECT *, evaluation_type || '|' || difficulty || '|' || strftime(timestamp, '%Y-%m-%d') AS sid FROM fx_eval_results)",
)
_add(
    "a12_evaluation_types",
    """SELECT t.covers, COUNT(*) AS n, COUNT(CASE WHEN is_correct THEN 1 END) AS correct FROM fx_eval_results JOIN
(VALUES ('sql', 'sql'), ('function', 'function'), ('mixed', 'sql'), ('mixed', 'function'), ('full', 'sql'), ('full', 'function')) AS t(covers, family)
ON evaluation_type = t.family GROUP BY t.covers""",
    "fx_eval_results",
)

# Questions


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


# Fixed values, written out again so that the check does not read the library's lists.
_BUDGET = "outlays spending budget defense military health categories functions departments federal".split()
_SERIES = ["cpi", "consumer price", "inflation", "employment cost", "workers", "compensation", "economic indicators", "productivity"]
_GDP = ["gdp", "industry", "industries", "contribution", "economic sectors"]
_REGION = ["state", "regional", "personal income", "per capita", "population"]


def _classified(series: list[str], fallback: str) -> str:
    return f"""coalesce(nullif(concat_ws(',', CASE WHEN {_any(_BUDGET)} THEN 'budget_outlays' END, CASE WHEN {_any(series)} THEN 'time_series_data' END,
  CASE WHEN {_any(_GDP)} THEN 'industry_gdp,gdp_by_industry' END, CASE WHEN {_any(_REGION)} THEN 'regional_data' END), ''), {fallback})"""


_P1 = _classified(_SERIES, "'budget_outlays'")
_P2 = _classified(
    _SERIES + ["time periods", "tracked"],
    f"CASE WHEN NOT {_any(['top', 'highest', 'most'])} AND {_any(['trend', 'change', 'growth', 'decline'])} THEN 'time_series_data' ELSE 'budget_outlays' END",
)
_Q = "qs AS (SELECT *, lower(question) AS q FROM fx_samples)"
_add("p1_classify_question", f"SELECT sample_id, {_P1} AS tables FROM qs", "fx_samples", ctes=_Q)
_add("p1_classify_documents", f"SELECT doc_id, {_P1} AS tables FROM (SELECT doc_id, lower(text) AS q FROM documents)")
_add("p2_classify_question_extended", f"SELECT sample_id, {_P2} AS tables FROM qs", "fx_samples", ctes=_Q)
_add(
    "p2_classify_conversations",
    f"SELECT conv_id, turn, role, {_P2} AS tables FROM (SELECT *, lower(text) AS q FROM conversations)",
)
_add(
    "p3_expected_call",
    """SELECT sample_id, 0 AS call_pos, name, CASE WHEN name IN ('get_cpi_data', 'get_employment_cost_index') THEN 'series_id' ELSE 'year' END AS arg_key,
  CASE WHEN name IN ('get_cpi_data', 'get_employment_cost_index') THEN 'str' ELSE 'int' END AS arg_kind,
  CASE name WHEN 'get_cpi_data' THEN 'CUUR0000SA0' WHEN 'get_employment_cost_index' THEN 'CIU1010000000000I' ELSE '2023' END AS arg_text
FROM (SELECT sample_id, """
    + _EXPECTED_NAME
    + " AS name FROM qs)",
    "fx_samples",
    ctes=_Q,
)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SCHEMA_CASE = (
    "CASE t "
    + " ".join(
        f"WHEN '{t}' THEN {_lit(prompts.schema_of(t))}" for t in FACT_COLUMNS
    )
    + " END"
)
_SCHEMA = f"""picked AS (SELECT sample_id, question, raw_difficulty, evaluation_type, string_split({_P1}, ',') AS ts FROM qs),
one AS (SELECT sample_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM picked),
texts AS (SELECT sample_id, string_agg({_SCHEMA_CASE}, {_lit(prompts.PART_BREAK)} ORDER BY i) AS body, COUNT(*) AS n FROM one GROUP BY sample_id),
schemas AS (SELECT sample_id, CASE WHEN n > 1 THEN 'RELEVANT TABLES FOR YOUR QUERY (' || n || ' tables):' || chr(10) || chr(10) || body ELSE body END AS schema_text FROM texts)"""
_add("p4_schema_text", "SELECT sample_id, schema_text FROM schemas", "fx_samples", ctes=f"{_Q},\n{_SCHEMA}")

_SYSTEM = {k: _lit(v) for k, v in prompts.SYSTEM_TEXT.items()}
_add(
    "p5_prompts",
    f"""SELECT sample_id, kind, role, content, length(content) AS n_chars FROM (
SELECT sample_id, 'sql' AS kind, 'system' AS role, {_SYSTEM['sql']} AS content FROM base
UNION ALL SELECT sample_id, 'sql', 'user', 'Question: ' || question || chr(10) || chr(10) || 'Context: ' || coalesce(context, 'No additional context provided') FROM base
UNION ALL SELECT sample_id, 'schema_sql', 'system', {_SYSTEM['schema_sql']} FROM base
UNION ALL SELECT sample_id, 'schema_sql', 'user', 'Question: ' || question || chr(10) || chr(10) || 'Database Schema:' || chr(10) || schema_text FROM base
UNION ALL SELECT sample_id, 'targeted_sql', 'system', {_SYSTEM['targeted_sql']} FROM base
UNION ALL SELECT sample_id, 'targeted_sql', 'user', 'Question: ' || question || chr(10) || chr(10) || 'Database Schema:' || chr(10) || schema_text FROM base
UNION ALL SELECT sample_id, 'catalogue', 'system', {_SYSTEM['catalogue_function']} || chr(10) || chr(10) || 'f()' FROM base
UNION ALL SELECT sample_id, 'catalogue', 'user', 'Question: ' || question FROM base
UNION ALL SELECT sample_id, 'function', 'system', {_SYSTEM['function']} FROM base
UNION ALL SELECT sample_id, 'function', 'user', 'Question: ' || question || chr(10) || chr(10) || 'Available Functions:' || chr(10) || '- f: d' || chr(10) || '- g: No description'
  || chr(10) || chr(10) || 'Context: ' || coalesce(context, 'No additional context provided') FROM base
UNION ALL SELECT sample_id, 'wrapped', 'system', 's' FROM base
UNION ALL SELECT sample_id, 'wrapped', 'user', CASE WHEN context IS NULL THEN question ELSE 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Query:' || chr(10) || question END FROM base)""",
    "fx_samples",
    ctes=f"{_Q},\n{_SCHEMA},\nbase AS (SELECT sample_id, question, schema_text, CASE WHEN raw_difficulty = 'HARD' THEN 'about ' || evaluation_type END AS context FROM picked JOIN schemas USING (sample_id))",
)
_add(
    "p6_year_limit",
    "SELECT sample_id, (content LIKE '%2024%' OR lower(content) LIKE '%not available%') AS respects_limit FROM fx_sql_responses",
    "fx_sql_responses",
)

# SQL extraction

_WORDS4 = "(SELECT|INSERT|UPDATE|DELETE)"
_WORDS7 = "(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_X1 = f"""basic AS (SELECT sample_id, model, content, CASE
  WHEN regexp_matches(content, '(?is)```sql\\s*(.*?)\\s*```') THEN regexp_extract(content, '(?is)```sql\\s*(.*?)\\s*```', 1)
  WHEN regexp_matches(upper(regexp_extract(content, '(?s)```\\s*(.*?)\\s*```', 1)), '{_WORDS4}') THEN regexp_extract(content, '(?s)```\\s*(.*?)\\s*```', 1)
  ELSE list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l, {_BLANK})), lambda l: regexp_matches(upper(l), '^{_WORDS4}'))[1] END AS raw FROM fx_sql_responses),
x1 AS (SELECT sample_id, nullif(trim(raw, {_BLANK}), '') AS sql FROM basic)"""
_add("x1_extract_sql_basic", "SELECT sample_id, sql FROM x1", "fx_sql_responses", ctes=_X1)


def _block(first: int) -> str:
    """Blocks by splitting; the line fallback by numbering lines from the first statement line."""
    return f"""cut AS (SELECT sample_id, model, content, CASE WHEN contains(content, '```sql') THEN string_split(string_split(content, '```sql')[2], '```')[1]
  WHEN contains(content, '```') THEN string_split(content, '```')[2] ELSE content END AS part FROM fx_sql_responses),
blocks AS (SELECT sample_id, model, content, trim(rtrim(trim(part, {_BLANK}), ';'), {_BLANK}) AS block FROM cut),
fallback AS (SELECT sample_id, trim(l, {_BLANK}) AS line, i FROM (SELECT sample_id, unnest(string_split(content, chr(10))) AS l,
  generate_subscripts(string_split(content, chr(10)), 1) AS i FROM blocks WHERE NOT regexp_matches(upper(block), '{_WORDS7}'))),
starts AS (SELECT sample_id, min(i) AS s FROM fallback WHERE regexp_matches(upper(line), '^{_WORDS7}') GROUP BY sample_id),
ends AS (SELECT f.sample_id, s, min(CASE WHEN line = '' THEN i - 1 WHEN contains(line, ';') AND i >= s + {first} THEN i END) AS e, max(i) AS last
  FROM fallback f JOIN starts USING (sample_id) WHERE i >= s GROUP BY f.sample_id, s),
gathered AS (SELECT f.sample_id, trim(rtrim(string_agg(line, ' ' ORDER BY i), ';')) AS line FROM fallback f JOIN ends USING (sample_id)
  WHERE i BETWEEN s AND coalesce(e, last) GROUP BY f.sample_id),
x AS (SELECT b.sample_id, b.model, CASE WHEN regexp_matches(upper(block), '{_WORDS7}') THEN block ELSE line END AS sql FROM blocks b LEFT JOIN gathered USING (sample_id))"""


_add("x2_extract_sql_block", "SELECT sample_id, sql FROM x", "fx_sql_responses", ctes=_block(1))
_add("x3_extract_sql_block_first_line", "SELECT sample_id, sql FROM x", "fx_sql_responses", ctes=_block(0))


def _clean(sql: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql}, '```[sS][qQ][lL]\\s*', '', 'g'),
  '```\\s*', '', 'g'), '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g'))"""


_add("x4_clean_sql", f"SELECT sample_id, {_clean('content')} AS sql FROM fx_sql_responses", "fx_sql_responses")
_add(
    "x5_statement_kind",
    "SELECT sample_id, CASE WHEN upper(sql) LIKE 'SELECT%' THEN 'rows' WHEN sql IS NOT NULL THEN 'affected' END AS kind FROM x1",
    "fx_sql_responses",
    ctes=_X1,
)
_add(
    "x6_table_audit",
    """SELECT model, CASE WHEN sql IS NULL THEN NULL WHEN sql LIKE '%budget!_outlays%' ESCAPE '!' THEN 'right'
  WHEN sql LIKE '%government!_spending%' ESCAPE '!' OR sql LIKE '%budget!_data%' ESCAPE '!' THEN 'wrong' ELSE 'none' END AS table_use, COUNT(*) AS n FROM x GROUP BY 1, 2""",
    "fx_sql_responses",
    ctes=_block(1),
)

# Which answers hold a statement that runs, by the twelve answer forms of the view.
_add(
    "m1_execution",
    """SELECT o_orderkey AS sample_id, 'm' || CAST(o_custkey % 4 AS STRING) AS model, ok AS executed, CAST(ok AS DOUBLE) AS execution_score
FROM (SELECT *, o_orderkey % 12 IN (0, 1, 7, 8, 9, 10) AS ok FROM orders)""",
)
_add(
    "m1_statement_rows",
    """SELECT sha256(sql) AS sql_id, n AS n_rows, n AS last_pos FROM (
SELECT 'SELECT * FROM budget_outlays WHERE fiscal_year = ' || y AS sql, COUNT(*) AS n FROM
  (SELECT DISTINCT year(o_orderdate) + 19 AS y FROM orders WHERE o_orderkey % 12 = 0) JOIN fx_budget_outlays ON fiscal_year = y GROUP BY y
UNION ALL SELECT 'SELECT SUM(outlay_amount) FROM budget_outlays', 1
UNION ALL SELECT 'select count(*) as n;', 1
UNION ALL SELECT 'SELECT function_name FROM budget_outlays', COUNT(*) FROM fx_budget_outlays
UNION ALL SELECT 'SELECT function_name, COUNT(*) AS n FROM budget_outlays WHERE fiscal_year >= 2015 GROUP BY function_name', COUNT(DISTINCT function_name) FROM fx_budget_outlays WHERE fiscal_year >= 2015)""",
    "fx_budget_outlays",
)


# Call extraction


def _kind(v: str, bad: bool) -> str:
    """Kind of written text; under the wide rule malformed numbers are told apart."""
    if not bad:
        return f"CASE WHEN regexp_full_match({v}, '[0-9]+') THEN 'int' WHEN regexp_full_match({v}, '[0-9]+[.][0-9]*|[.][0-9]+') THEN 'float' ELSE 'str' END"
    return f"""CASE WHEN regexp_full_match({v}, '-?[0-9]+') THEN 'int' WHEN regexp_full_match({v}, '-?([0-9]+[.][0-9]*|[.][0-9]+)') THEN 'float'
    WHEN regexp_full_match({v}, '[-.0-9]*[0-9][-.0-9]*') THEN 'bad' WHEN lower({v}) IN ('true', 'false') THEN 'bool' WHEN lower({v}) IN ('null', 'none') THEN 'null' ELSE 'str' END"""


_TEXT = """CASE arg_kind WHEN 'int' THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN 'float' THEN CAST(CAST(v AS DOUBLE) AS VARCHAR)
  WHEN 'bool' THEN CASE lower(v) WHEN 'true' THEN 'True' ELSE 'False' END WHEN 'null' THEN 'None' ELSE v END AS arg_text"""
_UNQUOTE = "trim(trim(trim({0}), '\"'''))"


def _plain_args(calls: str, typed: bool) -> str:
    """Comma-separated pairs of ``calls(sample_id, call_pos, name, params)``; the last value of a key stays."""
    kind = _kind("v", False) if typed else "'str'"
    return f"""pieces AS (SELECT sample_id, call_pos, unnest(string_split(params, ',')) AS piece, generate_subscripts(string_split(params, ','), 1) AS j FROM {calls}),
pairs AS (SELECT sample_id, call_pos, j, trim(split_part(piece, '=', 1)) AS arg_key, {_UNQUOTE.format("substr(piece, instr(piece, '=') + 1)")} AS v
  FROM pieces WHERE contains(piece, '=')),
args AS (SELECT sample_id, call_pos, arg_key, arg_kind, {_TEXT} FROM (SELECT *, {kind} AS arg_kind FROM pairs
  QUALIFY row_number() OVER (PARTITION BY sample_id, call_pos, arg_key ORDER BY j DESC) = 1))"""


def _labelled_args(calls: str, keys: str) -> str:
    """``word = value`` pairs, cut at the first malformed number; the last value of a key stays."""
    return f"""pairs AS (SELECT {keys}, unnest(regexp_extract_all(params, '(\\w+)\\s*=\\s*([^,]+)', 1)) AS arg_key,
  unnest(regexp_extract_all(params, '(\\w+)\\s*=\\s*([^,]+)', 2)) AS raw, generate_subscripts(regexp_extract_all(params, '(\\w+)\\s*=\\s*([^,]+)', 1), 1) AS j FROM {calls}),
kinds AS (SELECT {keys}, arg_key, j, v, {_kind('v', True)} AS arg_kind FROM (SELECT *, {_UNQUOTE.format("trim(raw, ' ' || chr(10))")} AS v FROM pairs)),
kept AS (SELECT * FROM (SELECT *, min(CASE WHEN arg_kind = 'bad' THEN j END) OVER (PARTITION BY {keys}) AS bad FROM kinds) WHERE bad IS NULL OR j < bad),
args AS (SELECT {keys}, arg_key, arg_kind, {_TEXT} FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {keys}, arg_key ORDER BY j DESC) = 1))"""


_ROWS = """SELECT r.sample_id, CAST(call_pos AS INT) AS call_pos, name, arg_key, arg_kind, arg_text
FROM fx_call_responses r LEFT JOIN calls USING (sample_id) LEFT JOIN args USING (sample_id, call_pos)"""
_PLAIN = "regexp_extract_all(content, '(\\w+)\\(([^)\\n]*)\\)', {0})"

_add(
    "x7_calls_json_and_text",
    _ROWS,
    "fx_call_responses",
    ctes="""found AS (SELECT sample_id, 1 AS tier, unnest(regexp_extract_all(content, '\\{[^{}]*"name"[^{}]*"arguments"[^{}]*\\}')) AS c, '' AS params,
  generate_subscripts(regexp_extract_all(content, '\\{[^{}]*"name"[^{}]*"arguments"[^{}]*\\}'), 1) AS j FROM fx_call_responses
UNION ALL SELECT sample_id, 2, unnest("""
    + _PLAIN.format(1)
    + "), unnest("
    + _PLAIN.format(2)
    + "), generate_subscripts("
    + _PLAIN.format(1)
    + """, 1) FROM fx_call_responses),
calls AS (SELECT sample_id, CASE WHEN tier = 1 THEN json_extract_string(c, '$.name') ELSE c END AS name, params,
  row_number() OVER (PARTITION BY sample_id ORDER BY tier, j) - 1 AS call_pos FROM found),
"""
    + _plain_args("calls", False),
)
_add(
    "x8_calls_tiered",
    """SELECT r.sample_id, CAST(call_pos AS INT) AS call_pos, name, arg_key, arg_kind, arg_text
FROM fx_call_responses r LEFT JOIN all_calls USING (sample_id) LEFT JOIN all_args USING (sample_id, call_pos)""",
    "fx_call_responses",
    ctes="""objects AS (SELECT sample_id, unnest(regexp_extract_all(content, '(?s)\\{.*?\\}')) AS o, generate_subscripts(regexp_extract_all(content, '(?s)\\{.*?\\}'), 1) AS j FROM fx_call_responses),
flat AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY j) - 1 AS call_pos, json_extract(o, '$') AS c FROM objects
  WHERE json_valid(o) AND json_extract_string(CASE WHEN json_valid(o) THEN o ELSE '{}' END, '$.function_name') IS NOT NULL),
lists AS (SELECT sample_id, content AS t FROM fx_call_responses WHERE json_valid(content) AND content LIKE '[%' AND sample_id NOT IN (SELECT sample_id FROM flat)),
spread AS (SELECT sample_id, t, CAST(unnest(range(CAST(json_array_length(t) AS BIGINT))) AS BIGINT) AS call_pos FROM lists),
whole AS (SELECT sample_id, call_pos, json_extract(t, '$[' || call_pos || ']') AS c FROM spread),
json_calls AS (SELECT * FROM flat UNION ALL SELECT * FROM whole),
json_keys_of AS (SELECT sample_id, call_pos, c, unnest(json_keys(json_extract(c, '$.parameters'))) AS arg_key FROM json_calls WHERE json_type(c, '$.parameters') = 'OBJECT'),
json_values AS (SELECT sample_id, call_pos, arg_key, json_extract(c, '$.parameters."' || arg_key || '"') AS v FROM json_keys_of),
found AS (SELECT sample_id, unnest("""
    + _PLAIN.format(1)
    + ") AS name, unnest("
    + _PLAIN.format(2)
    + ") AS params, generate_subscripts("
    + _PLAIN.format(1)
    + """, 1) AS j FROM fx_call_responses WHERE sample_id NOT IN (SELECT sample_id FROM json_calls)),
calls AS (SELECT sample_id, name, params, row_number() OVER (PARTITION BY sample_id ORDER BY j) - 1 AS call_pos FROM found
  WHERE name IN ('get_cpi_data', 'get_employment_cost_index', 'get_gdp_by_industry', 'get_regional_income', 'get_budget_outlays')),
"""
    + _plain_args("calls", True)
    + f""",
all_calls AS (SELECT sample_id, call_pos, name FROM calls UNION ALL SELECT sample_id, call_pos, json_extract_string(c, '$.function_name') FROM json_calls),
all_args AS (SELECT sample_id, call_pos, arg_key, arg_kind, arg_text FROM args UNION ALL SELECT sample_id, call_pos, arg_key, {_typed('v')} FROM json_values)""",
)

_FIVE = ", ".join(f"'{f}'" for f in FUNCTION_DEFAULTS)
_FORMS = [
    "(?i)Function:\\s*(\\w+)\\s*\\nParameters:\\s*([^\\n]+)",
    "(?i)Function:\\s*(\\w+)\\s*Parameters:\\s*([^\\n]+)",
    "(?i)(\\w+)\\s*\\(([^)\\n]*)\\)",
    "(?i)call\\s+(\\w+)\\s*\\(([^)\\n]*)\\)",
    "(?i)use\\s+(\\w+)\\s*\\(([^)\\n]*)\\)",
]
_DEFAULT_ROWS = ", ".join(
    f"('{f}', {i}, '{k}', '{'str' if isinstance(v, str) else 'int'}', '{v}')"
    for i, (f, d) in enumerate(FUNCTION_DEFAULTS.items())
    for k, v in d.items()
)
_X9 = (
    "forms AS ("
    + "\nUNION ALL ".join(
        f"SELECT sample_id, {i} AS form, unnest(regexp_extract_all(content, '{p}', 1)) AS name, unnest(regexp_extract_all(content, '{p}', 2)) AS params, "
        f"generate_subscripts(regexp_extract_all(content, '{p}', 1), 1) AS j FROM fx_call_responses"
        for i, p in enumerate(_FORMS)
    )
    + f"""),
written AS (SELECT sample_id, name, params, row_number() OVER (PARTITION BY sample_id ORDER BY form, j) - 1 AS call_pos FROM forms WHERE name IN ({_FIVE})),
defaults AS (SELECT * FROM (VALUES {_DEFAULT_ROWS}) AS d(name, nth, arg_key, arg_kind, arg_text)),
mentioned AS (SELECT sample_id, name, row_number() OVER (PARTITION BY sample_id ORDER BY nth) - 1 AS call_pos FROM fx_call_responses
  JOIN (SELECT DISTINCT name, nth FROM defaults) ON contains(lower(content), name) WHERE sample_id NOT IN (SELECT sample_id FROM written)),
"""
    + _labelled_args("written", "sample_id, call_pos").replace("args AS (SELECT", "written_args AS (SELECT", 1)
    + """,
calls AS (SELECT sample_id, call_pos, name FROM written UNION ALL SELECT sample_id, call_pos, name FROM mentioned),
args AS (SELECT * FROM written_args UNION ALL SELECT sample_id, call_pos, arg_key, arg_kind, arg_text FROM mentioned JOIN defaults USING (name))"""
)
_add("x9_calls_labelled", _ROWS, "fx_call_responses", ctes=_X9)

_X10 = "texts AS (SELECT sample_id, content AS params FROM fx_call_responses),\n" + _labelled_args("texts", "sample_id")
_add("x10_parameters", "SELECT sample_id, arg_key, arg_text FROM args", "fx_call_responses", ctes=_X10)
_add(
    "x11_typed_parameters",
    """SELECT sample_id, arg_key, arg_kind, CASE WHEN arg_kind IN ('int', 'float') THEN round(CAST(arg_text AS DOUBLE), 6)
  WHEN arg_kind = 'bool' THEN CASE arg_text WHEN 'True' THEN 1.0 ELSE 0.0 END END AS arg_number FROM args""",
    "fx_call_responses",
    ctes=_X10,
)
_FULL = """full_args AS (SELECT sample_id, call_pos, arg_key, arg_kind, arg_text FROM args UNION ALL
  SELECT sample_id, call_pos, d.arg_key, d.arg_kind, d.arg_text FROM calls JOIN defaults d USING (name)
  WHERE NOT EXISTS (SELECT 1 FROM args a WHERE a.sample_id = calls.sample_id AND a.call_pos = calls.call_pos AND a.arg_key = d.arg_key))"""
_add(
    "x12_default_parameters",
    _ROWS.replace("LEFT JOIN args", "LEFT JOIN full_args"),
    "fx_call_responses",
    ctes=f"{_X9},\n{_FULL}",
)

# Calls as stored lists: both sides as rows

_LISTS = f"""sides AS (SELECT sample_id, 'e' AS side, expected AS t FROM fx_call_lists UNION ALL SELECT sample_id, 'p', predicted FROM fx_call_lists),
call_places AS (SELECT sample_id, side, t, CAST(unnest(range(CAST(json_array_length(t) AS BIGINT))) AS INT) AS pos FROM sides),
calls AS (SELECT sample_id, side, pos, json_extract_string(t, '$[' || pos || '].name') AS name, json_extract(t, '$[' || pos || '].arguments') AS a FROM call_places),
arg_keys AS (SELECT sample_id, side, pos, name, a, unnest(json_keys(a)) AS key FROM calls),
arg_values AS (SELECT sample_id, side, pos, name, key, json_extract(a, '$."' || key || '"') AS v FROM arg_keys),
typed AS (SELECT sample_id, side, pos, name, key, {_typed('v')} FROM arg_values),
args AS (SELECT sample_id, side, pos, name, key, arg_kind AS kind, arg_text AS sval,
  CASE WHEN arg_kind IN ('int', 'float') THEN CAST(arg_text AS DOUBLE) WHEN arg_kind = 'bool' THEN CASE arg_text WHEN 'True' THEN 1.0 ELSE 0.0 END END AS nval FROM typed),
toks AS (SELECT *, CASE WHEN nval IS NOT NULL THEN 'n:' || nval ELSE kind || ':' || sval END AS tok FROM args),
sizes AS (SELECT l.sample_id, l.model, (SELECT COUNT(*) FROM calls c WHERE c.sample_id = l.sample_id AND side = 'e') AS ne,
  (SELECT COUNT(*) FROM calls c WHERE c.sample_id = l.sample_id AND side = 'p') AS np FROM fx_call_lists l)"""


def _lists(name: str, body: str, ctes: str = "") -> None:
    _add(name, body, "fx_call_lists", ctes=_LISTS + (",\n" + ctes if ctes else ""))


_WELL = """CASE name WHEN 'get_cpi_data' THEN ks @> ['start_year', 'end_year'] WHEN 'get_employment_cost_index' THEN ks @> ['start_year', 'end_year']
  WHEN 'get_gdp_by_industry' THEN ks @> ['year'] WHEN 'get_regional_income' THEN ks @> ['state', 'year'] ELSE name = 'get_budget_outlays' END"""
_lists(
    "x13_well_formed",
    f"SELECT sample_id, pos AS call_pos, {_WELL} AS is_well_formed FROM (SELECT *, json_keys(a) AS ks FROM calls WHERE side = 'p')",
)

_SIMILAR = """pairs AS (SELECT e.sample_id, e.pos AS ep, p.pos AS pp, e.name = p.name AS same_name FROM calls e JOIN calls p ON e.sample_id = p.sample_id AND e.side = 'e' AND p.side = 'p'),
pair_keys AS (SELECT sample_id, ep, pp, key, max(etok) AS etok, max(ptok) AS ptok, COUNT(etok) AS e, COUNT(ptok) AS p FROM (
  SELECT pairs.sample_id, ep, pp, key, tok AS etok, NULL AS ptok FROM pairs JOIN toks t ON t.sample_id = pairs.sample_id AND side = 'e' AND pos = ep
  UNION ALL SELECT pairs.sample_id, ep, pp, key, NULL, tok FROM pairs JOIN toks t ON t.sample_id = pairs.sample_id AND side = 'p' AND pos = pp) GROUP BY ALL),
pair_args AS (SELECT sample_id, ep, pp, sum(e) AS en, sum(p) AS pn, COUNT(*) AS u,
  count_if(coalesce(etok, 'null:None') = coalesce(ptok, 'null:None')) AS m FROM pair_keys GROUP BY ALL),
pair_scores AS (SELECT sample_id, ep, pp, CASE WHEN same_name THEN 0.5 ELSE 0.0 END + 0.5 * CASE WHEN u IS NULL THEN 1.0 WHEN en = 0 OR pn = 0 THEN 0.0 ELSE m / u END AS s
  FROM pairs LEFT JOIN pair_args USING (sample_id, ep, pp)),
best AS (SELECT sample_id, ep, max(s) AS s FROM pair_scores GROUP BY ALL),
partial AS (SELECT z.sample_id, ne, np, CASE WHEN ne = 0 OR np = 0 THEN 0.0 ELSE (SELECT sum(s) FROM best b WHERE b.sample_id = z.sample_id) / ne END AS partial_score FROM sizes z),
signed AS (SELECT sample_id, side, row_number() OVER (PARTITION BY sample_id, side ORDER BY name, pos) AS i, name || '(' || coalesce(
  (SELECT string_agg(key || '=' || tok, ';' ORDER BY key) FROM toks t WHERE t.sample_id = calls.sample_id AND t.side = calls.side AND t.pos = calls.pos), '') || ')' AS s FROM calls),
lined AS (SELECT sample_id, side, string_agg(s, ' ' ORDER BY i) AS s FROM signed GROUP BY ALL),
exact AS (SELECT z.sample_id, partial_score, CASE WHEN ne = 0 THEN np > 0 WHEN ne <> np THEN false ELSE e.s = p.s END AS is_exact FROM partial z
  LEFT JOIN lined e ON e.sample_id = z.sample_id AND e.side = 'e' LEFT JOIN lined p ON p.sample_id = z.sample_id AND p.side = 'p')"""
_lists(
    "m7_call_exact_match",
    "SELECT sample_id, is_exact, round(CASE WHEN is_exact THEN 1.0 ELSE partial_score END, 6) AS match_score FROM exact",
    _SIMILAR,
)
_lists("m8_call_partial_score", "SELECT sample_id, round(partial_score, 6) AS partial_score FROM exact", _SIMILAR)

_NAMES = """names AS (SELECT sample_id, name, max(CASE side WHEN 'e' THEN 1 ELSE 0 END) AS e, max(CASE side WHEN 'p' THEN 1 ELSE 0 END) AS p FROM calls GROUP BY ALL),
name_sets AS (SELECT z.sample_id, z.model, ne, np, coalesce(sum(e), 0) AS es, coalesce(sum(p), 0) AS ps, coalesce(sum(e * p), 0) AS shared
  FROM sizes z LEFT JOIN names USING (sample_id) GROUP BY ALL),
f1 AS (SELECT sample_id, model, CASE WHEN ne = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * shared / (es + ps) END AS selection FROM name_sets)"""
_lists(
    "m9_selection_exact",
    "SELECT sample_id, CASE WHEN es = shared AND ps = shared THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM name_sets",
    _NAMES,
)
_lists("m10_selection_f1", "SELECT sample_id, round(selection, 6) AS score FROM f1", _NAMES)

_STRICT = """(e.tok = p.tok OR (e.kind = 'str' AND p.kind = 'str' AND lower(e.sval) = lower(p.sval)) OR coalesce(abs(e.nval - p.nval) < 0.001, false))"""
_FLOAT = "coalesce({0}.nval, CASE WHEN {0}.kind = 'str' THEN TRY_CAST({0}.sval AS DOUBLE) END)"
_INT = "coalesce(trunc({0}.nval), CASE WHEN {0}.kind = 'str' AND regexp_full_match({0}.sval, '[0-9]+') THEN CAST({0}.sval AS DOUBLE) END)"
_LENIENT = f"""(e.tok = p.tok OR lower(e.sval) = lower(p.sval) OR coalesce(abs({_FLOAT.format('e')} - {_FLOAT.format('p')}) < 0.01, false)
  OR coalesce(abs({_INT.format('e')} - {_INT.format('p')}) <= 1, false))"""
_KEY_PARAMETERS = "('series_id', 'year', 'start_year', 'end_year', 'industry', 'state')"

_lists(
    "m11_parameters_strict",
    """SELECT sample_id, round(CASE WHEN ne = 0 THEN 1.0 WHEN ne <> np THEN 0.0 ELSE (SELECT avg(s) FROM name_scores n WHERE n.sample_id = z.sample_id) END, 6) AS score FROM sizes z""",
    f"""last_calls AS (SELECT sample_id, side, name, max(pos) AS pos FROM calls GROUP BY ALL),
judged AS (SELECT t.*, count_if(key IN {_KEY_PARAMETERS}) OVER (PARTITION BY t.sample_id, t.side, t.pos) AS n_key FROM toks t JOIN last_calls USING (sample_id, side, name, pos)),
chosen AS (SELECT * FROM judged WHERE n_key = 0 OR key IN {_KEY_PARAMETERS}),
arg_scores AS (SELECT e.sample_id, e.name, avg(CASE WHEN p.key IS NOT NULL AND {_STRICT} THEN 1.0 ELSE 0.0 END) AS s
  FROM chosen e LEFT JOIN judged p ON p.sample_id = e.sample_id AND p.side = 'p' AND p.name = e.name AND p.key = e.key WHERE e.side = 'e' GROUP BY ALL),
name_scores AS (SELECT e.sample_id, e.name, CASE WHEN p.name IS NULL THEN 0.0 ELSE coalesce(a.s, 1.0) END AS s FROM last_calls e
  LEFT JOIN last_calls p ON p.sample_id = e.sample_id AND p.side = 'p' AND p.name = e.name LEFT JOIN arg_scores a ON a.sample_id = e.sample_id AND a.name = e.name WHERE e.side = 'e')""",
)
_SOFT = f"""first_calls AS (SELECT sample_id, name, min(pos) AS pos FROM calls WHERE side = 'p' GROUP BY ALL),
soft_args AS (SELECT e.sample_id, e.pos, avg(CASE WHEN p.key IS NOT NULL AND {_LENIENT} THEN 1.0 ELSE 0.0 END) AS s
  FROM toks e LEFT JOIN first_calls f ON f.sample_id = e.sample_id AND f.name = e.name
  LEFT JOIN toks p ON p.sample_id = e.sample_id AND p.side = 'p' AND p.pos = f.pos AND p.key = e.key WHERE e.side = 'e' GROUP BY ALL),
soft_calls AS (SELECT e.sample_id, e.pos, CASE WHEN f.pos IS NULL THEN 0.0 WHEN a.s IS NOT NULL THEN a.s
  WHEN EXISTS (SELECT 1 FROM toks t WHERE t.sample_id = e.sample_id AND t.side = 'p' AND t.pos = f.pos) THEN 0.5 ELSE 1.0 END AS s
  FROM calls e LEFT JOIN first_calls f ON f.sample_id = e.sample_id AND f.name = e.name LEFT JOIN soft_args a ON a.sample_id = e.sample_id AND a.pos = e.pos WHERE e.side = 'e'),
soft AS (SELECT z.sample_id, CASE WHEN ne = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN np = 0 THEN 0.0
  ELSE (SELECT avg(s) FROM soft_calls c WHERE c.sample_id = z.sample_id) END AS parameters FROM sizes z),
well AS (SELECT sample_id, avg(CASE WHEN {_WELL} THEN 1.0 ELSE 0.0 END) AS execution FROM (SELECT *, json_keys(a) AS ks FROM calls WHERE side = 'p') GROUP BY ALL),
family AS (SELECT sample_id, model, selection, parameters, coalesce(execution, 0.0) AS execution, (0.4 * selection + 0.6 * parameters) * 0.8 AS result
  FROM f1 JOIN soft USING (sample_id) LEFT JOIN well USING (sample_id))"""
_lists("m12_parameters_lenient", "SELECT sample_id, round(parameters, 6) AS score FROM family", f"{_NAMES},\n{_SOFT}")
for _name, _rule in (("m13_strict_value_match", _STRICT), ("m14_lenient_value_match", _LENIENT)):
    _lists(
        _name,
        f"""SELECT e.sample_id, e.name, e.key AS arg_key, coalesce({_rule}, false) AS is_match FROM toks e LEFT JOIN toks p
ON p.sample_id = e.sample_id AND p.pos = e.pos AND p.key = e.key AND p.side = 'p' WHERE e.side = 'e'""",
    )
_lists("m17_well_formed_share", "SELECT sample_id, round(execution, 6) AS score FROM family", f"{_NAMES},\n{_SOFT}")
_lists("m18_result_proxy", "SELECT sample_id, round(result, 6) AS result FROM family", f"{_NAMES},\n{_SOFT}")
_lists(
    "m20_weighted_verdict",
    """SELECT sample_id, selection >= 0.8 AND parameters >= 0.6 AS is_correct,
  round(0.3 * selection + 0.3 * parameters + 0.2 * execution + 0.2 * result, 6) AS score FROM family""",
    f"{_NAMES},\n{_SOFT}",
)
_lists(
    "a10_component_means",
    """SELECT model, COUNT(*) AS total_samples, round(avg(CAST(selection AS DECIMAL(18,9))), 6) AS mean_selection, round(avg(CAST(parameters AS DECIMAL(18,9))), 6) AS mean_parameters,
  round(avg(CAST(execution AS DECIMAL(18,9))), 6) AS mean_execution, round(avg(CAST(result AS DECIMAL(18,9))), 6) AS mean_result FROM family GROUP BY model""",
    f"{_NAMES},\n{_SOFT}",
)

# Result sets

_ROW_VIEWS = ("fx_expected_rows", "fx_candidate_rows")
_COMMON = """keyed AS (SELECT sample_id, 'c' AS side, list_sort([CAST(v1 AS VARCHAR), CAST(v2 AS VARCHAR), v3]) AS k FROM fx_candidate_rows
  UNION ALL SELECT sample_id, 'e', list_sort([CAST(v1 AS VARCHAR), CAST(v2 AS VARCHAR), v3]) FROM fx_expected_rows),
counted AS (SELECT sample_id, k, count_if(side = 'c') AS c, count_if(side = 'e') AS e FROM keyed GROUP BY ALL),
alike AS (SELECT sample_id, CAST(sum(c) AS BIGINT) AS candidate_rows, CAST(sum(e) AS BIGINT) AS expected_rows, CAST(sum(least(c, e)) AS BIGINT) AS common_rows,
  2.0::DOUBLE * sum(least(c, e)) / (sum(c) + sum(e)) AS similarity FROM counted GROUP BY sample_id)"""
_add(
    "m3_result_similarity",
    "SELECT sample_id, candidate_rows, expected_rows, common_rows, round(similarity, 6) AS similarity FROM alike",
    *_ROW_VIEWS,
    ctes=_COMMON,
)
_add("m4_result_gate", "SELECT sample_id, similarity >= 0.9 AS passes FROM alike", *_ROW_VIEWS, ctes=_COMMON)
_add(
    "m5_binary_verdict",
    """SELECT sample_id, x AS execution_score, round(r, 6) AS result_score, x >= 0.8 AND r >= 0.9 AS is_correct, round(0.4 * x + 0.6 * r, 6) AS score FROM (
SELECT sample_id, CASE WHEN sample_id % 13 <> 4 THEN 1.0::DOUBLE ELSE 0.0 END AS x,
  CASE WHEN sample_id % 13 = 4 THEN 0.0::DOUBLE WHEN expected_rows = 0 THEN 1.0 ELSE similarity END AS r FROM alike)""",
    *_ROW_VIEWS,
    ctes=_COMMON,
)
_ORDERED = """c AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY place, v1, v2, v3) AS pos FROM fx_candidate_rows),
e AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY place, v1, v2, v3) AS pos FROM fx_expected_rows),
lined AS (SELECT coalesce(c.sample_id, e.sample_id) AS sample_id, COUNT(c.sample_id) AS candidate_rows, COUNT(e.sample_id) AS expected_rows,
  bool_and(c.v1 IS NOT DISTINCT FROM e.v1 AND c.v2 IS NOT DISTINCT FROM e.v2 AND c.v3 IS NOT DISTINCT FROM e.v3) AS is_equal
  FROM c FULL JOIN e ON c.sample_id = e.sample_id AND c.pos = e.pos GROUP BY 1)"""
_add("m2_ordered_equality", "SELECT * FROM lined", *_ROW_VIEWS, ctes=_ORDERED)
_add(
    "m6_database_verdict",
    """SELECT sample_id, CASE WHEN sample_id % 17 = 1 OR sample_id % 13 = 4 THEN false WHEN sample_id % 11 = 5 THEN true WHEN sample_id % 7 = 2 THEN false ELSE is_equal END AS is_correct FROM lined""",
    *_ROW_VIEWS,
    ctes=_ORDERED,
)

# Calls run against the facts

_FACTS = ("fx_call_responses", "fx_time_series_data", "fx_industry_gdp", "fx_regional_data")
_ASKED = f"""{_FULL},
asked AS (SELECT sample_id, call_pos, name, max(CASE WHEN arg_key = CASE WHEN name = 'get_gdp_by_industry' THEN 'industry' WHEN name = 'get_regional_income' THEN 'state' ELSE 'series_id' END THEN arg_text END) AS k,
  max(CASE WHEN arg_key = CASE WHEN name IN ('get_gdp_by_industry', 'get_regional_income') THEN 'year' ELSE 'start_year' END THEN TRY_CAST(arg_text AS INT) END) AS low,
  max(CASE WHEN arg_key = CASE WHEN name IN ('get_gdp_by_industry', 'get_regional_income') THEN 'year' ELSE 'end_year' END THEN TRY_CAST(arg_text AS INT) END) AS high
  FROM calls JOIN full_args USING (sample_id, call_pos) GROUP BY ALL),
ran AS (SELECT sample_id, call_pos, low IS NOT NULL AND high IS NOT NULL AS ok, CASE
  WHEN name = 'get_gdp_by_industry' THEN EXISTS (SELECT 1 FROM industries f WHERE (k = 'ALL' OR industry_name = k) AND year = low)
  WHEN name = 'get_regional_income' THEN EXISTS (SELECT 1 FROM states f WHERE state_name = k AND year = low)
  ELSE EXISTS (SELECT 1 FROM series f WHERE series_id = k AND year BETWEEN low AND high) END AS hit FROM asked),
shares AS (SELECT r.sample_id, r.model, r.content, COUNT(call_pos) AS np, coalesce(avg(CAST(ok AS INT)), 0.0) AS execution, coalesce(avg(CAST(ok AND hit AS INT)), 0.0) AS result
  FROM fx_call_responses r LEFT JOIN ran USING (sample_id) GROUP BY ALL)"""
_YEARS = """series AS (SELECT DISTINCT series_id, year FROM fx_time_series_data), industries AS (SELECT DISTINCT industry_name, year FROM fx_industry_gdp),
states AS (SELECT DISTINCT state_name, year FROM fx_regional_data)"""
_RUN = f"{_X9},\n{_YEARS},\n{_ASKED}"
_add("m15_execution_success", "SELECT sample_id, round(execution, 6) AS execution FROM shares", *_FACTS, ctes=_RUN)
_add(
    "m16_call_rows",
    """, lined AS (SELECT sample_id, call_pos, max(CASE WHEN arg_key = 'line_code' THEN arg_text END) AS code FROM full_args GROUP BY ALL),
wide AS (SELECT a.*, CASE WHEN code IN ('SA1-2', 'SA1-3') THEN code ELSE 'SA1-1' END AS line FROM asked a LEFT JOIN lined USING (sample_id, call_pos)),
found AS (
  SELECT sample_id, call_pos, name, 'series' AS domain, k, '' AS measure, f.year, period_value AS period, numeric_value AS value
  FROM wide JOIN fx_series_points f ON name NOT IN ('get_gdp_by_industry', 'get_regional_income') AND series_id = k AND f.year BETWEEN low AND high
  UNION ALL SELECT sample_id, call_pos, name, 'industry', k, '', f.year, NULL, gdp_value
  FROM wide JOIN fx_industry_gdp f ON name = 'get_gdp_by_industry' AND (k = 'ALL' OR industry_name = k) AND f.year = low
  UNION ALL SELECT sample_id, call_pos, name, 'state', k, line, f.year, NULL,
    CAST(CASE line WHEN 'SA1-1' THEN personal_income WHEN 'SA1-2' THEN population ELSE per_capita_income END AS DOUBLE)
  FROM wide JOIN fx_regional_data f ON name = 'get_regional_income' AND state_name = k AND f.year = low)
SELECT sample_id, CAST(call_pos AS INT) AS call_pos, name AS function_name, domain, k AS key, measure, year, CAST(period AS INT) AS period, value FROM found""",
    "fx_series_points",
    *_FACTS,
    ctes=_RUN,
)
_add("m16_result_accuracy", "SELECT sample_id, round(result, 6) AS result FROM shares", *_FACTS, ctes=_RUN)

# The flagship: expected calls by the event's question, then all four components.
_FLAGSHIP = (
    _RUN
    + """,
wanted AS (SELECT event_id AS sample_id, CASE WHEN value < 20 THEN 'easy' WHEN value < 60 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE event_type WHEN 'click' THEN 'get_cpi_data' WHEN 'signup' THEN 'get_employment_cost_index' WHEN 'purchase' THEN 'get_regional_income' ELSE 'get_gdp_by_industry' END AS name FROM events),
chosen_names AS (SELECT s.sample_id, COUNT(DISTINCT c.name) AS n, count_if(c.name = w.name) AS hits FROM shares s JOIN wanted w USING (sample_id) LEFT JOIN calls c USING (sample_id) GROUP BY ALL),
key_args AS (SELECT w.sample_id, max(CASE WHEN arg_key = 'series_id' AND lower(arg_text) = CASE w.name WHEN 'get_cpi_data' THEN 'cuur0000sa0' WHEN 'get_employment_cost_index' THEN 'ciu1010000000000i' END THEN 1
    WHEN arg_key = 'year' AND arg_kind = 'int' AND arg_text = '2023' AND w.name IN ('get_gdp_by_industry', 'get_regional_income') THEN 1 ELSE 0 END) AS hit
  FROM wanted w JOIN calls c ON c.sample_id = w.sample_id AND c.name = w.name JOIN args a ON a.sample_id = c.sample_id AND a.call_pos = c.call_pos GROUP BY ALL),
answers AS (SELECT s.sample_id, s.model, w.difficulty, content = 'No function fits.' AS failed, CASE WHEN n = 1 AND hits > 0 THEN 1.0 ELSE 0.0 END AS selection,
  CASE WHEN np = 1 THEN coalesce(hit, 0) ELSE 0 END AS parameters, execution, result
  FROM shares s JOIN wanted w USING (sample_id) JOIN chosen_names USING (sample_id) LEFT JOIN key_args USING (sample_id)),
verdicts AS (SELECT sample_id, model, difficulty, 'function' AS evaluation_type, CASE WHEN failed THEN 'timeout' END AS error_message,
  CASE WHEN failed THEN 0.0::DOUBLE ELSE (selection + parameters + execution + result) / 4 END AS score FROM answers)"""
)
_add(
    "m19_mean_verdict",
    "SELECT sample_id, model, score >= 0.75 AS is_correct, round(score, 6) AS score FROM verdicts",
    *_FACTS,
    ctes=_FLAGSHIP,
)
_add(
    "m21_error_rows",
    "SELECT error_message, COUNT(*) AS n, COUNT(CASE WHEN score >= 0.75 THEN 1 END) AS correct, max(score) AS max_score FROM verdicts WHERE error_message IS NOT NULL GROUP BY 1",
    *_FACTS,
    ctes=_FLAGSHIP,
)
_add(
    "function_evaluation",
    f"""SELECT model, evaluation_type, difficulty, {_LEVEL}, {_METRICS}, {_ERROR_RATE} FROM (SELECT *, score >= 0.75 AS is_correct, 1.0::DOUBLE AS execution_time FROM verdicts)
GROUP BY GROUPING SETS ((model), (model, evaluation_type), (model, difficulty), (model, evaluation_type, difficulty))""",
    *_FACTS,
    ctes=_FLAGSHIP,
)

# Data access and query shapes

_TS = "SELECT record_id, series_id, year, period_value, numeric_value FROM fx_time_series_data WHERE "
_add("g1_cpi_data", _TS + "series_id = 'CUUR0000SA0' AND year BETWEEN 2015 AND 2018", "fx_time_series_data")
_add("g2_employment_cost_index", _TS + "series_id = 'CIU1010000000000I' AND year BETWEEN 2020 AND 2024", "fx_time_series_data")
_add("g3_productivity_data", _TS + "series_id = 'PRS85006092' AND year BETWEEN 2014 AND 2016", "fx_time_series_data")
_add(
    "g4_gdp_by_industry",
    """SELECT 'ALL' AS asked, industry_name, year, gdp_value FROM fx_industry_gdp WHERE year = 2016
UNION ALL SELECT 'SMALL', industry_name, year, gdp_value FROM fx_industry_gdp WHERE year = 2017 AND industry_name = 'SMALL'""",
    "fx_industry_gdp",
)
_add(
    "g5_regional_income",
    """SELECT state_name, year, c AS line_code, CAST(CASE c WHEN 'SA1-1' THEN personal_income WHEN 'SA1-2' THEN population ELSE per_capita_income END AS DOUBLE) AS value
FROM fx_regional_data, (VALUES ('SA1-1'), ('SA1-2'), ('SA1-3')) AS t(c) WHERE state_name = 'NATION_3' AND year = 2016""",
    "fx_regional_data",
)
_add(
    "g6_budget_outlays",
    """SELECT record_id, function_name, fiscal_year, outlay_amount FROM fx_budget_outlays
WHERE function_name = '2-HIGH' AND fiscal_year = 2016 AND outlay_amount BETWEEN 1000 AND 200000""",
    "fx_budget_outlays",
)


def _money(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


_add(
    "q1_top_functions",
    f"SELECT function_name, {_money('outlay_amount')} AS total_outlays FROM fx_budget_outlays WHERE fiscal_year >= 2016 GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
    "fx_budget_outlays",
)
_add(
    "q2_category_values",
    "SELECT year, numeric_value FROM fx_time_series_data WHERE category = 'consumer_price_index' AND year BETWEEN 2015 AND 2017 ORDER BY year",
    "fx_time_series_data",
)
_add(
    "q3_top_industries",
    "SELECT industry_name, gdp_value FROM fx_industry_gdp WHERE year = 2016 ORDER BY gdp_value DESC LIMIT 10",
    "fx_industry_gdp",
)
_add(
    "q3_top_states",
    "SELECT state_name, personal_income FROM fx_regional_data WHERE year = 2016 ORDER BY personal_income DESC LIMIT 10",
    "fx_regional_data",
)
_add(
    "q4_contribution_totals",
    f"SELECT industry_name, {_money('gdp_contribution')} AS total_contribution FROM fx_gdp_by_industry WHERE year = 2016 GROUP BY 1",
    "fx_gdp_by_industry",
)
_add("q5_indicator_names", "SELECT DISTINCT indicator_name, category FROM fx_economic_indicators WHERE source = 'BLS'", "fx_economic_indicators")
_add(
    "q6_outlay_lookup",
    "SELECT record_id, function_name, fiscal_year, outlay_amount FROM fx_budget_outlays WHERE function_name = '1-URGENT' AND fiscal_year = 2017",
    "fx_budget_outlays",
)
_add(
    "q7_top_per_year",
    """SELECT fiscal_year, record_id, function_name, outlay_amount, CAST(row_number() OVER (PARTITION BY fiscal_year ORDER BY outlay_amount DESC, record_id) AS INT) AS rank
FROM fx_budget_outlays QUALIFY rank <= 3""",
    "fx_budget_outlays",
)
_add("q8_row_count", "SELECT COUNT(*) AS row_count FROM fx_budget_outlays", "fx_budget_outlays")

# Analytic functions

_add(
    "d1_query_economic_data",
    f"""SELECT year, data_points, t.a AS aggregation, CASE t.a WHEN 'sum' THEN s WHEN 'average' THEN round(s / data_points, 4) WHEN 'min' THEN lo WHEN 'max' THEN hi ELSE data_points END AS value
FROM (SELECT year, COUNT(*) AS data_points, {_money('numeric_value')} AS s, min(numeric_value) AS lo, max(numeric_value) AS hi FROM fx_time_series_data
  WHERE source = 'BLS' AND year BETWEEN 2015 AND 2018 AND series_id = 'CUUR0000SA0' AND category = 'consumer_price_index' GROUP BY year),
(VALUES ('sum'), ('average'), ('min'), ('max'), ('count')) AS t(a)""",
    "fx_time_series_data",
)
_add(
    "d2_query_budget_data",
    f"""SELECT function_name, fiscal_year, round({_money('outlay_amount')} / COUNT(*), 4) AS value FROM fx_budget_outlays
WHERE fiscal_year BETWEEN 2015 AND 2018 AND outlay_amount BETWEEN 1000 AND 300000 GROUP BY 1, 2""",
    "fx_budget_outlays",
)


def _totals(view: str, category: str, year: str, value: str, where: str = "true") -> str:
    return f"""totals AS (SELECT {category} AS category, {year} AS year, {_money(value)} AS total FROM {view} WHERE {where} GROUP BY 1, 2),
grown AS (SELECT *, total / lag(total) OVER (PARTITION BY category ORDER BY year) - 1 AS g FROM totals)"""


_BUDGET_TOTALS = _totals(
    "fx_budget_outlays", "function_name", "fiscal_year", "outlay_amount",
    "fiscal_year BETWEEN 2014 AND 2020 AND function_name IN ('1-URGENT', '2-HIGH', '5-LOW')",
)
_SLOPE = "round(regr_slope(total, year - 2014), 2) AS slope, round(avg(g), 6) AS mean_growth, round(stddev_samp(g), 6) AS volatility"
_NEXT = "round(regr_intercept(total, year - 2014) + regr_slope(total, year - 2014) * (max(year) - 2013), 2) AS forecast"
_CORRELATED = """SELECT a.category AS category1, b.category AS category2, round(corr(a.total, b.total), 6) AS correlation
FROM totals a JOIN totals b ON a.year = b.year AND {0} GROUP BY 1, 2"""
_add("d3_trend", f"SELECT category, {_SLOPE} FROM grown GROUP BY 1", "fx_budget_outlays", ctes=_BUDGET_TOTALS)
_add("d3_forecast", f"SELECT category, {_NEXT} FROM grown GROUP BY 1", "fx_budget_outlays", ctes=_BUDGET_TOTALS)
_add("d3_comparison", "SELECT category, year, total, round(g, 6) AS growth_rate FROM grown", "fx_budget_outlays", ctes=_BUDGET_TOTALS)
_add("d3_correlation", _CORRELATED.format("a.category < b.category"), "fx_budget_outlays", ctes=_BUDGET_TOTALS)
_add(
    "d4_compare_categories",
    f"""SELECT year, value1, value2, t.c AS comparison_type, round(CASE t.c WHEN 'absolute' THEN value1 - value2 WHEN 'relative' THEN (value1 - value2) / value2
  WHEN 'percentage' THEN 100 * value1 / whole ELSE value1 / value2 END, 6) AS result FROM (SELECT fiscal_year AS year,
  {_money("CASE WHEN function_name = '1-URGENT' THEN outlay_amount END")} AS value1, {_money("CASE WHEN function_name = '5-LOW' THEN outlay_amount END")} AS value2,
  {_money('outlay_amount')} AS whole FROM fx_budget_outlays WHERE fiscal_year BETWEEN 2014 AND 2020 GROUP BY 1),
(VALUES ('absolute'), ('relative'), ('percentage'), ('ratio')) AS t(c)""",
    "fx_budget_outlays",
)
_add(
    "d4_compare_growth",
    """SELECT year, round(a / lag(a) OVER w - 1, 6) AS value1, round(b / lag(b) OVER w - 1, 6) AS value2,
  round(a / lag(a) OVER w - b / lag(b) OVER w, 6) AS result FROM y WINDOW w AS (ORDER BY year)""",
    "fx_budget_outlays",
    ctes=f"""y AS (SELECT fiscal_year AS year, {_money("CASE WHEN function_name = '1-URGENT' THEN outlay_amount END")} AS a,
  {_money("CASE WHEN function_name = '5-LOW' THEN outlay_amount END")} AS b FROM fx_budget_outlays WHERE fiscal_year BETWEEN 2014 AND 2020 GROUP BY 1)""",
)
_add(
    "d5_seasonal",
    """SELECT series_id, period_value, round(avg(numeric_value) / any_value(m), 6) AS seasonal_index
FROM fx_time_series_data JOIN (SELECT series_id, avg(numeric_value) AS m FROM fx_time_series_data GROUP BY 1) USING (series_id) GROUP BY 1, 2""",
    "fx_time_series_data",
)
_add(
    "d5_anomaly",
    """SELECT series_id, record_id, year, numeric_value, round((numeric_value - m) / sd, 4) AS z_score FROM recent
JOIN (SELECT series_id, avg(numeric_value) AS m, stddev_samp(numeric_value) AS sd FROM recent GROUP BY 1) USING (series_id) WHERE abs((numeric_value - m) / sd) > 1.6448536269514722""",
    "fx_time_series_data",
    ctes="recent AS (SELECT * FROM fx_time_series_data WHERE year > (SELECT max(year) FROM fx_time_series_data) - 5)",
)
_add(
    "d5_cyclical",
    """SELECT a.series_id, CAST(12 AS INT) AS lag, round(corr(a.mean, b.mean), 6) AS autocorrelation FROM monthly a JOIN monthly b ON a.series_id = b.series_id AND a.month = b.month + 12 GROUP BY 1""",
    "fx_time_series_data",
    ctes="monthly AS (SELECT series_id, year * 12 + period_value AS month, avg(numeric_value) AS mean FROM fx_time_series_data GROUP BY 1, 2)",
)
_add(
    "d5_trend",
    f"SELECT category, {_SLOPE}, {_NEXT} FROM grown GROUP BY 1",
    "fx_time_series_data",
    ctes=_totals("fx_time_series_data", "series_id", "year", "numeric_value"),
)
_add(
    "d5_correlation",
    _CORRELATED.format("(a.category, b.category) IN (('BLS', 'BEA'), ('BLS', 'OMB'), ('BEA', 'OMB'))"),
    "fx_time_series_data",
    ctes=_totals("fx_time_series_data", "source", "year", "numeric_value"),
)

# SQL evaluations: the outcome follows from the twelve answer forms and five kinds of question.
_FORMS_OF = """forms AS (SELECT r.sample_id, r.model, s.difficulty, r.sample_id % 12 AS answer, r.sample_id % 5 AS kind
  FROM fx_sql_responses r JOIN fx_sql_samples s USING (sample_id))"""
_add(
    "sql_evaluation",
    """SELECT sample_id, model, difficulty, ran AND result >= 0.9 AS is_correct, round(CASE WHEN ran THEN 0.4 + 0.6 * result ELSE 0.0 END, 6) AS score FROM (
SELECT *, answer IN (0, 1, 7, 8, 9, 10) AS ran, CASE WHEN kind IN (1, 2) THEN 1.0::DOUBLE WHEN kind = 0 AND answer = 7 THEN 1.0
  WHEN kind = 4 AND answer = 7 THEN 2.0 / 3 ELSE 0.0 END AS result FROM forms)""",
    "fx_sql_responses",
    "fx_sql_samples",
    ctes=_FORMS_OF,
)
_add(
    "sql_basic_evaluation",
    """SELECT sample_id, model, ok AS is_correct, CAST(ok AS DOUBLE) AS score FROM (SELECT *, answer IN (0, 1, 5, 7, 9, 10) AND
  (kind = 1 OR (kind IN (0, 2) AND answer = 7) OR (kind = 3 AND answer = 1)) AS ok FROM forms)""",
    "fx_sql_responses",
    "fx_sql_samples",
    ctes=_FORMS_OF,
)

# Combined data, and patterns of a given confidence

_COMBINED = f"""totals AS (SELECT function_name AS category, fiscal_year AS year, {_money('outlay_amount')} AS total FROM fx_budget_outlays WHERE fiscal_year BETWEEN 2012 AND 2016 GROUP BY 1, 2
  UNION ALL SELECT category, year, {_money('numeric_value')} FROM fx_time_series_data WHERE year BETWEEN 2012 AND 2016 GROUP BY 1, 2)"""
_BOTH = ("fx_budget_outlays", "fx_time_series_data")
_add(
    "d3_combined_trend",
    """SELECT category, round(avg(g), 6) AS mean_growth, round(stddev_samp(g), 6) AS volatility
FROM (SELECT *, total / lag(total) OVER (PARTITION BY category ORDER BY year) - 1 AS g FROM totals) GROUP BY 1""",
    *_BOTH,
    ctes=_COMBINED,
)
_add(
    "d3_combined_correlation",
    """SELECT a.category AS category1, b.category AS category2, COUNT(*) AS years, round(corr(a.total, b.total), 6) AS correlation
FROM totals a JOIN totals b ON a.year = b.year AND a.category < b.category GROUP BY 1, 2""",
    *_BOTH,
    ctes=_COMBINED,
)
_add(
    "d4_compare_efficiency",
    f"""SELECT year, round(a, 6) AS value1, round(b, 6) AS value2, round(a / b, 6) AS result FROM (SELECT fiscal_year AS year,
  {_money("CASE WHEN function_name = '1-URGENT' THEN outlay_amount END")} / count_if(function_name = '1-URGENT') AS a,
  {_money("CASE WHEN function_name = '5-LOW' THEN outlay_amount END")} / count_if(function_name = '5-LOW') AS b
  FROM fx_budget_outlays WHERE fiscal_year BETWEEN 2014 AND 2020 GROUP BY 1)""",
    "fx_budget_outlays",
)


def _normal(z: str) -> str:
    """Two-sided probability of a normal value nearer to 0."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    return f"(1 - {poly} * exp(-{x} * {x}))"


_SERIES_TOTALS = f"totals AS (SELECT series_id AS category, year, {_money('numeric_value')} AS total FROM fx_time_series_data GROUP BY 1, 2)"
_add(
    "d5_confident_trend",
    """, fitted AS (SELECT category, round(regr_slope(total, year - 2014), 2) AS slope, COUNT(*) AS years, abs(corr(year::DOUBLE, total)) AS r FROM totals GROUP BY 1),
angled AS (SELECT *, years - 2 AS v, atan(r * sqrt((years - 2) / greatest(1 - r * r, 1e-12)) / sqrt(years - 2)) AS a FROM fitted WHERE years > 2),
summed AS (SELECT *, 1 + coalesce(list_sum(list_transform(range(1, (CASE WHEN v % 2 = 1 THEN (v - 1) // 2 ELSE v // 2 END)::BIGINT), lambda k:
  pow(cos(a), 2 * k) * list_product(list_transform(range(1, k + 1), lambda j: CASE WHEN v % 2 = 1 THEN 2.0 * j / (2 * j + 1) ELSE (2.0 * j - 1) / (2 * j) END)))), 0) AS s FROM angled),
told AS (SELECT category, slope, years, CASE WHEN v % 2 = 1 THEN 2 / pi() * (a + CASE WHEN v > 1 THEN sin(a) * cos(a) * s ELSE 0 END) ELSE sin(a) * s END AS confidence FROM summed)
SELECT category, slope, years, round(confidence, 4) AS confidence FROM told WHERE confidence >= 0.1""",
    "fx_time_series_data",
    ctes=_SERIES_TOTALS,
)
_add(
    "d5_confident_correlation",
    f"""SELECT category1, category2, years, round(r, 6) AS correlation, round(c, 4) AS confidence FROM (SELECT *, {_normal('(atanh(greatest(least(r, 1 - 1e-12), -1 + 1e-12)) * sqrt(years - 3))')} AS c FROM (
SELECT a.category AS category1, b.category AS category2, COUNT(*) AS years, corr(a.total, b.total) AS r
FROM totals a JOIN totals b ON a.year = b.year AND a.category < b.category GROUP BY 1, 2) WHERE years > 3) WHERE c >= 0.5""",
    "fx_time_series_data",
    ctes=_SERIES_TOTALS,
)
_add(
    "d5_confident_seasonal",
    f"""SELECT series_id, period_value, round(s / n / mean, 6) AS seasonal_index, round(confidence, 4) AS confidence FROM cells JOIN (
  SELECT series_id, mean, (1 + sign(z) * {_normal('z')}) / 2 AS confidence FROM (
    SELECT series_id, mean, ((1 - 2 / (9 * d2)) * f - (1 - 2 / (9 * d1))) / sqrt(2 / (9 * d2) * f * f + 2 / (9 * d1)) AS z FROM (
      SELECT series_id, total / n AS mean, k - 1.0::DOUBLE AS d1, n - k * 1.0::DOUBLE AS d2, cbrt(((m - total * total / n) / (k - 1)) / ((q - m) / (n - k))) AS f FROM (
        SELECT series_id, COUNT(*) AS k, sum(n) AS n, sum(s) AS total, sum(s * s / n) AS m, sum(q) AS q FROM cells GROUP BY 1)))) USING (series_id)
WHERE confidence >= 0.05""",
    "fx_time_series_data",
    ctes="""cells AS (SELECT series_id, period_value, CAST(sum(CAST(numeric_value AS DECIMAL(18,2))) AS DOUBLE) AS s, COUNT(*) AS n,
  CAST(sum(CAST(CAST(numeric_value AS DECIMAL(18,2)) AS DECIMAL(15,2)) * CAST(numeric_value AS DECIMAL(15,2))) AS DOUBLE) AS q FROM fx_time_series_data GROUP BY 1, 2)""",
)
_add(
    "d5_confident_cyclical",
    f"""SELECT series_id, CAST(lag AS INT) AS lag, pairs, r AS autocorrelation, round(c, 4) AS confidence FROM (
  SELECT *, {_normal('(atanh(greatest(least(r, 1 - 1e-12), -1 + 1e-12)) * sqrt(pairs - 3))')} AS c, row_number() OVER (PARTITION BY series_id ORDER BY r DESC, lag) AS place FROM (
    SELECT a.series_id, a.month - b.month AS lag, COUNT(*) AS pairs, round(corr(a.mean, b.mean), 6) AS r
    FROM monthly a JOIN monthly b ON a.series_id = b.series_id AND a.month - b.month BETWEEN 1 AND 24 GROUP BY 1, 2 HAVING COUNT(*) >= 12)) WHERE place = 1 AND c >= 0.5""",
    "fx_time_series_data",
    ctes=f"monthly AS (SELECT series_id, year * 12 + period_value AS month, {_money('numeric_value')} / COUNT(numeric_value) AS mean FROM fx_time_series_data GROUP BY 1, 2)",
)
_add(
    "m1_same_meaning",
    """, years AS (SELECT fiscal_year, COUNT(*) AS n FROM fx_budget_outlays GROUP BY 1)
SELECT fiscal_year, kind, texts::BIGINT AS texts, runs::BIGINT AS runs, executed::BIGINT AS executed, CASE WHEN kind = 'count' THEN CAST(n AS VARCHAR) END AS value
FROM years, (VALUES ('count', 3, 1, 3), ('sum', 1, 1, 1), ('broken', 2, 2, 0)) f(kind, texts, runs, executed)""",
    "fx_budget_outlays",
)
