"""Adapter views: the shapes the library reads, derived from the test tables.

One SQL text per view serves both Spark and the checking engine. Every view covers its
whole source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallywright.session import configure
from tallywright.sources.responses import spread

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "fx_budget_outlays": """
SELECT o_orderkey AS record_id, o_orderstatus AS superfunction, o_orderpriority AS function_name,
       CAST(year(o_orderdate) + 19 AS INT) AS fiscal_year, o_totalprice AS outlay_amount,
       'USD' AS unit, 'OMB' AS source
FROM orders""",
    "fx_time_series_data": """
SELECT l_orderkey * 10 + l_linenumber AS record_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'CUUR0000SA0' WHEN 1 THEN 'CIU1010000000000I' ELSE 'PRS85006092' END AS series_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'consumer_price_index' WHEN 1 THEN 'employment_cost_index' ELSE 'productivity_measures' END AS category,
       CASE l_returnflag WHEN 'N' THEN 'BLS' WHEN 'A' THEN 'BEA' ELSE 'OMB' END AS source,
       CAST(year(l_shipdate) + 19 AS INT) AS year, 'M' AS period_type,
       CAST(month(l_shipdate) AS INT) AS period_value, l_linestatus AS geographic_code,
       CAST(l_extendedprice AS STRING) AS raw_value, l_extendedprice AS numeric_value,
       (l_returnflag = 'R') AS is_estimated
FROM lineitem""",
    # One point per series and month.
    "fx_series_points": """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'CUUR0000SA0' WHEN 1 THEN 'CIU1010000000000I' ELSE 'PRS85006092' END AS series_id,
       CAST(year(l_shipdate) + 19 AS INT) AS year, CAST(month(l_shipdate) AS INT) AS period_value, MAX(l_extendedprice) AS numeric_value
FROM lineitem GROUP BY 1, 2, 3""",
    "fx_industry_gdp": """
SELECT p_type AS industry_name, CAST(year(l_shipdate) + 19 AS INT) AS year,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp_value, 'USD' AS unit, 'BEA' AS source
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "fx_gdp_by_industry": """
SELECT p_type AS industry_name, CAST(year(l_shipdate) + 19 AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp_contribution, 'BEA' AS source
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "fx_regional_data": """
SELECT n_name AS state_name, r_name AS region, CAST(year(o_orderdate) + 19 AS INT) AS year,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS personal_income,
       COUNT(DISTINCT c_custkey) AS population,
       ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(DISTINCT c_custkey), 2) AS per_capita_income
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "fx_economic_indicators": """
SELECT DISTINCT p_brand AS indicator_name, p_type AS category,
       CASE p_size % 3 WHEN 0 THEN 'BLS' WHEN 1 THEN 'BEA' ELSE 'OMB' END AS source
FROM part""",
    "fx_samples": """
SELECT o_orderkey AS sample_id,
       CASE o_orderkey % 11
         WHEN 0 THEN 'What were the top 3 federal spending categories in ' || CAST(year(o_orderdate) + 19 AS STRING) || '?'
         WHEN 1 THEN 'How did the CPI move after ' || CAST(year(o_orderdate) + 19 AS STRING) || '?'
         WHEN 2 THEN 'Which industries led GDP?'
         WHEN 3 THEN 'What was personal income by state?'
         WHEN 4 THEN 'How did pay of workers develop in specific sectors?'
         WHEN 5 THEN 'List the highest values.'
         WHEN 6 THEN 'Describe the trend over the time periods.'
         WHEN 7 THEN 'What is the population of each state and its GDP contribution?'
         WHEN 8 THEN 'Which industry grew most by GDP in ' || CAST(year(o_orderdate) + 19 AS STRING) || '?'
         WHEN 9 THEN 'Where did growth decline?'
         ELSE 'What was the Employment Cost of ' || o_orderpriority || '?' END AS question,
       CASE WHEN o_orderkey % 2 = 0 THEN 'sql' ELSE 'function' END AS evaluation_type,
       CASE WHEN o_orderkey % 10 < 3 THEN 'Easy' WHEN o_orderkey % 10 < 7 THEN 'medium' WHEN o_orderkey % 10 < 8 THEN 'unrated' ELSE 'HARD' END AS raw_difficulty
FROM orders""",
    "fx_sql_responses": """
SELECT o_orderkey AS sample_id, 'm' || CAST(o_custkey % 4 AS STRING) AS model,
       CASE o_orderkey % 12
         WHEN 0 THEN 'Sure.' || chr(10) || '```sql' || chr(10) || 'SELECT * FROM budget_outlays -- all' || chr(10) || 'WHERE fiscal_year = ' || CAST(year(o_orderdate) + 19 AS STRING) || ';' || chr(10) || '```'
         WHEN 1 THEN '```' || chr(10) || 'SELECT SUM(outlay_amount) FROM budget_outlays' || chr(10) || '```'
         WHEN 2 THEN 'Here it is:' || chr(10) || 'SELECT a FROM government_spending;' || chr(10) || 'Done.'
         WHEN 3 THEN 'No updates: data is Not Available after 2023.'
         WHEN 4 THEN 'I do not know.'
         WHEN 5 THEN '```SQL' || chr(10) || 'WITH t AS (SELECT 1 AS x) SELECT x FROM t' || chr(10) || '```'
         WHEN 6 THEN 'SELECT /* c */ x   FROM budget_data;;'
         WHEN 7 THEN '```' || chr(10) || 'plain words' || chr(10) || '```' || chr(10) || '  select count(*) as n; -- first' || chr(10) || 'from budget_outlays;' || chr(10) || 'rest'
         WHEN 8 THEN '```text' || chr(10) || 'none' || chr(10) || '```' || chr(10) || 'SELECT function_name' || chr(10) || chr(9) || 'FROM budget_outlays' || chr(10) || chr(10) || 'The end.'
         WHEN 9 THEN '```sql' || chr(10) || 'SELECT function_name, COUNT(*) AS n FROM budget_outlays WHERE fiscal_year >= 2015 GROUP BY function_name'
         WHEN 10 THEN 'Try: ```sql SELECT fiscal_year, function_name FROM budget_outlays WHERE record_id < 0``` or ```sql SELECT 2```'
         ELSE 'DELETE FROM budget_outlays;' END AS content,
       100 + o_custkey % 500 AS prompt_tokens, 10 + o_custkey % 90 AS completion_tokens
FROM orders""",
    # What each SQL question expects: rows as JSON, and a reference statement.
    "fx_sql_samples": """
SELECT o_orderkey AS sample_id, 'How much in ' || CAST(year(o_orderdate) + 19 AS STRING) || '?' AS question, 'sql' AS evaluation_type,
       CASE WHEN o_orderstatus = 'F' THEN 'easy' WHEN o_orderstatus = 'O' THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE o_orderkey % 5 WHEN 0 THEN '[{"n": 1}]' WHEN 1 THEN '[]' WHEN 3 THEN '[{"year": 2014, "name": "x"}]' WHEN 4 THEN '[{"n": 1}, {"n": 2}]' END AS expected,
       CASE o_orderkey % 5 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN '' WHEN 2 THEN 'SELECT count(*) AS n' WHEN 3 THEN 'SELECT SUM(outlay_amount) FROM budget_outlays'
         ELSE 'SELECT broken FROM nowhere' END AS ground_truth_sql
FROM orders""",
    "fx_call_responses": """
SELECT event_id AS sample_id, 'm' || CAST(user_id % 4 AS STRING) AS model,
       CASE event_id % 12
         WHEN 0 THEN 'Function: get_cpi_data' || chr(10) || 'Parameters: series_id=CUUR0000SA0, start_year=' || CAST(2010 + event_id % 11 AS STRING) || ', end_year=2020'
         WHEN 1 THEN 'get_gdp_by_industry(year=' || CAST(2010 + event_id % 13 AS STRING) || ', industry=SMALL)'
         WHEN 2 THEN 'call get_regional_income(state=NATION_' || CAST(event_id % 30 AS STRING) || ', year=2016)'
         WHEN 3 THEN 'You could use GET_Employment_Cost_Index here, or get_cpi_data.'
         WHEN 4 THEN 'get_gdp_by_industry(year=2019, industry=31-33, table_id=5)'
         WHEN 5 THEN 'No function fits.'
         WHEN 6 THEN 'Please use get_employment_cost_index (start_year = 2014, end_year = "2016") and then sum(a, b).'
         WHEN 7 THEN '{"name": "get_cpi_data", "arguments": null} then get_budget_outlays(min_amount=' || CAST(value AS STRING) || ', fiscal_year=02016)'
         WHEN 8 THEN '{"function_name": "get_budget_outlays"} {"function_name": "get_gdp_by_industry", "year": 2016}'
         WHEN 9 THEN '[{"function_name": "get_gdp_by_industry", "parameters": {"year": ' || CAST(2014 + event_id % 9 AS STRING) || '}}, {"function_name": "get_cpi_data", "parameters": {"start_year": 2014, "end_year": "2016"}}]'
         WHEN 10 THEN 'get_cpi_data(start_year=2016, end_year=2018, start_year=2015) get_productivity_data()'
         ELSE 'Function: get_regional_income Parameters: state=' || event_type || ', year=-5, flag=TRUE, note=None, x=1.50' END AS content
FROM events""",
    # Expected and predicted calls as stored JSON lists, in cycles of different length.
    "fx_call_lists": """
SELECT event_id AS sample_id, 'm' || CAST(user_id % 4 AS STRING) AS model,
       CASE event_id % 7
         WHEN 0 THEN '[]'
         WHEN 1 THEN '[{"name": "get_cpi_data", "arguments": {"series_id": "CUUR0000SA0", "start_year": ' || CAST(2010 + user_id % 7 AS STRING) || ', "end_year": 2020}}]'
         WHEN 2 THEN '[{"name": "get_gdp_by_industry", "arguments": {"year": ' || CAST(2014 + user_id % 5 AS STRING) || ', "industry": "small", "table_id": null}}, {"name": "get_cpi_data", "arguments": {}}]'
         WHEN 3 THEN '[{"name": "get_budget_outlays", "arguments": {"min_amount": ' || CAST(value AS STRING) || ', "exact": true}}]'
         WHEN 4 THEN '[{"name": "get_regional_income", "arguments": {"state": "' || event_type || '", "year": "2016"}}, {"name": "get_regional_income", "arguments": {"state": "CA", "year": 2016, "line_code": "SA1-1"}}]'
         WHEN 5 THEN '[{"name": "get_budget_outlays", "arguments": {}}]'
         ELSE '[{"name": "get_cpi_data", "arguments": {"start_year": 2015, "end_year": 2019}}, {"name": "get_budget_outlays", "arguments": {"k": ' || props || '}}, {"name": "get_gdp_by_industry", "arguments": {"year": 2016.5}}]' END AS expected,
       CASE event_id % 9
         WHEN 0 THEN '[]'
         WHEN 1 THEN '[{"name": "get_cpi_data", "arguments": {"series_id": "cuur0000sa0", "start_year": ' || CAST(2010 + event_id % 7 AS STRING) || ', "end_year": "2020"}}]'
         WHEN 2 THEN '[{"name": "get_cpi_data", "arguments": {}}, {"name": "get_gdp_by_industry", "arguments": {"year": 2016, "industry": "SMALL"}}]'
         WHEN 3 THEN '[{"name": "get_budget_outlays", "arguments": {"min_amount": ' || CAST(floor(value) AS STRING) || ', "exact": 1}}]'
         WHEN 4 THEN '[{"name": "get_regional_income", "arguments": {"state": "CA", "year": 2016, "line_code": "SA1-1"}}, {"name": "get_regional_income", "arguments": {"state": "click", "year": "2016"}}]'
         WHEN 5 THEN '[{"name": "get_budget_outlays", "arguments": {}}]'
         WHEN 6 THEN '[{"name": "get_gdp_by_industry", "arguments": {"year": 2016.4995}}, {"name": "get_budget_outlays", "arguments": {"k": ' || props || '}}, {"name": "get_cpi_data", "arguments": {"end_year": 2019, "start_year": 2015.0}}]'
         WHEN 7 THEN '[{"name": "get_cpi_data", "arguments": {"start_year": 2014, "end_year": 2020, "note": "None"}}, {"name": "get_cpi_data", "arguments": {"start_year": 2015, "end_year": 2018}}, {"name": "get_productivity_data", "arguments": {"start_year": 2015}}]'
         ELSE '[{"name": "get_budget_outlays", "arguments": {"min_amount": "' || CAST(value AS STRING) || '", "exact": "True"}}, {"name": "get_unknown", "arguments": {"year": 2016}}]' END AS predicted
FROM events""",
    # Two stored results per sample; sample 0 holds about a third of all rows.
    "fx_expected_rows": """
SELECT CASE WHEN l_quantity > 33 THEN 0 WHEN l_partkey % 97 = 7 THEN -l_partkey ELSE l_partkey END AS sample_id,
       l_orderkey * 10 + l_linenumber AS place, l_orderkey % 40 AS v1, l_linenumber AS v2, l_returnflag AS v3
FROM lineitem""",
    "fx_candidate_rows": """
SELECT CASE WHEN l_quantity > 33 THEN 0 ELSE l_partkey END AS sample_id,
       l_orderkey * 10 + l_linenumber AS place, l_orderkey % 40 AS v1,
       CASE WHEN l_suppkey % 50 = 3 THEN l_linenumber + 100 ELSE l_linenumber END AS v2, l_returnflag AS v3
FROM lineitem""",
    "fx_eval_results": """
SELECT event_id AS sample_id, 'm' || CAST(user_id % 4 AS STRING) AS model,
       CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'improved' END AS run_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'sql' ELSE 'function' END AS evaluation_type,
       CASE event_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       (event_type <> 'error' AND value >= 25.0) AS is_correct,
       CASE WHEN event_type = 'error' THEN 0.0E0 ELSE LEAST(value / 50.0E0, 1.0E0) END AS score,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 10.0E0 END AS execution_time,
       CASE WHEN event_type = 'error' THEN 'E' || CAST(user_id % 5 AS STRING) END AS error_message,
       ts AS timestamp
FROM events""",
    # Question sets as stored documents: one JSON document per row.
    "fx_sql_documents": """
SELECT o_orderkey AS doc_id,
       CASE WHEN o_orderkey % 2 = 0
         THEN '{"questions": [{"question_id": "q' || CAST(o_orderkey AS STRING) || '", "question_text": "How much in ' || CAST(year(o_orderdate) + 19 AS STRING) || '?", "difficulty": "HARD", "reference_sql": "SELECT 1", "category": "' || o_orderpriority || '"}, {"question": "What?", "sql": "SELECT 2", "complexity": "low", "context": "c' || o_orderstatus || '"}]}'
         ELSE '{"ground_truth_data": [{"question": "Why ' || o_orderstatus || '?", "difficulty": "unrated", "ground_truth_sql": "SELECT ' || CAST(o_custkey AS STRING) || '"}]}' END AS body
FROM orders""",
    "fx_function_documents": """
SELECT event_id AS doc_id,
       CASE event_id % 3
         WHEN 0 THEN '{"available_functions": [{"name": "f", "description": "d"}], "questions": [{"question_id": "q' || CAST(event_id AS STRING) || '", "question_text": "Which ' || event_type || '?", "difficulty": "easy", "workflow_type": "single", "function_sequence": [{"function_name": "get_cpi_data", "parameters": {"start_year": ' || CAST(2014 + user_id % 5 AS STRING) || ', "end_year": "2020"}}, {"function_name": "get_budget_outlays"}]}]}'
         WHEN 1 THEN '{"questions": [{"question": "Second ' || event_type || '?", "category": "c", "available_functions": [{"name": "g"}], "ground_truth_functions": [{"name": "get_gdp_by_industry", "arguments": {"year": 2016, "rate": ' || CAST(value AS STRING) || ', "flag": true, "none": null}}]}]}'
         ELSE '{"ground_truth_data": [{"difficulty": "Medium"}]}' END AS body
FROM events""",
    "fx_catalogue_documents": """
SELECT event_id AS doc_id,
       CASE event_id % 2
         WHEN 0 THEN '{"questions": [{"question_id": ' || CAST(event_id AS STRING) || ', "question": "Find ' || event_type || '", "difficulty": 3, "expected_functions": [{"function_name": "get_regional_income", "parameters": {"state": "CA", "year": ' || CAST(2014 + user_id % 5 AS STRING) || '}}]}, {"question": "No functions", "difficulty": "Hard", "category": "lookup"}]}'
         ELSE '{"questions": [{"difficulty": "easy", "context": "x", "expected_functions": [{"function_name": "get_budget_outlays", "parameters": {}}]}]}' END AS body
FROM events""",
}


def prelude(*names: str) -> str:
    """``WITH`` clause that defines the named views over the base tables."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)


def register_tables(spark: SparkSession, sf_dir: str, sql: str, wide: bool = False) -> None:
    """Register the base tables that a statement names."""
    for name in BASE_TABLES:
        if re.search(rf"\b{name}\b", sql):
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (spread(df) if wide else df).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if wide else df


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """An adapter view as a DataFrame over the Parquet files below ``sf_dir``.

    ``wide`` spreads small inputs over all cores, for queries with much work per row.
    """
    register_tables(configure(spark), sf_dir, VIEWS[name], wide)
    return spark.sql(VIEWS[name])
