"""Evaluations end to end: samples and recorded answers in, result rows out.

Every evaluation is ``(samples, responses, ...) -> results`` with the columns of a stored
result plus ``run_id`` and ``model``. Answers that carry an error stay in as wrong results
with score 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.call_text import (
    extract_calls_json_and_text,
    extract_calls_labelled,
    extract_calls_tiered,
)
from tallywright.functions.questions import DIFFICULTIES, expected_calls
from tallywright.functions.sql_text import (
    clean_sql,
    extract_sql_basic,
    extract_sql_block,
    statement_kind,
    table_audit,
)
from tallywright.operators import call_scores as scores
from tallywright.operators.call_execution import (
    execution_success,
    result_accuracy,
    with_requests,
)
from tallywright.operators.metrics import (
    EVALUATION_TYPES,
    all_metrics,
    detailed_breakdown,
    error_patterns,
    error_rates,
    metrics_by,
    overall_metrics,
)
from tallywright.operators.presence import missing
from tallywright.operators.result_sets import database_verdict, sql_verdict
from tallywright.operators.statement_results import (
    expected_rows,
    statement_equality,
    statement_similarity,
)
from tallywright.operators.statement_runs import (
    run_statements,
    statement_id,
    with_execution,
)
from tallywright.session import stored
from tallywright.sources.fact_tables import register_facts
from tallywright.sources.question_sets import mixed_samples
from tallywright.sources.responses import normalise_responses
from tallywright.sources.sinks import save_results

KEYS = ["run_id", "model", "sample_id"]
NO_SQL = "No SQL found in response"
NO_ANSWER = "No answer recorded"


def answered(samples: DataFrame, responses: DataFrame) -> DataFrame:
    """Samples with their recorded answers, one row per answer."""
    answers = normalise_responses(responses)
    if "run_id" not in answers.columns:
        answers = answers.withColumn("run_id", F.lit("run"))
    kept = ["run_id", "model", "sample_id", "content", "error"]
    if "execution_time_ms" in answers.columns:
        kept.append("execution_time_ms")
    return answers.select(*kept).join(samples, "sample_id")


def unknown_answers(samples: DataFrame, responses: DataFrame) -> DataFrame:
    """Recorded answers to samples that are not in the set, which no evaluation counts."""
    return normalise_responses(responses).join(samples.select("sample_id").distinct(), "sample_id", "left_anti")


def unanswered(samples: DataFrame, responses: DataFrame) -> DataFrame:
    """``(run_id, model, sample_id)`` of samples without an answer in a run of the responses."""
    return missing(samples, responses, ["run_id", "model"])


def missing_results(samples: DataFrame, responses: DataFrame) -> DataFrame:
    """Result rows of the samples that a run did not answer: wrong, score 0, with ``NO_ANSWER`` as their error."""
    answers = normalise_responses(responses)
    if "run_id" not in answers.columns:
        answers = answers.withColumn("run_id", F.lit("run"))
    rows = unanswered(samples, answers.select("run_id", "model", "sample_id")).join(samples, "sample_id")
    rows = rows.withColumns({"content": F.lit(None).cast("string"), "error": F.lit(NO_ANSWER)})
    return result_row(rows, F.lit(False), F.lit(0.0), F.struct(F.lit(NO_ANSWER).alias("missing")))


def result_row(df: DataFrame, is_correct: Column, score: Column, details: Column, error: Column | None = None) -> DataFrame:
    """Bring scored answers into the form of stored results; failed answers score 0."""
    failed = F.col("error").isNotNull()
    seconds = F.col("execution_time_ms") / 1000 if "execution_time_ms" in df.columns else F.lit(None).cast("double")
    message = F.col("error") if error is None else F.coalesce(F.col("error"), error)
    return df.select(
        *KEYS,
        "question",
        "evaluation_type",
        "difficulty",
        F.col("content").alias("model_response"),
        F.when(failed, False).otherwise(F.coalesce(is_correct, F.lit(False))).alias("is_correct"),
        F.when(failed, 0.0).otherwise(F.coalesce(score, F.lit(0.0))).alias("score"),
        seconds.alias("execution_time"),
        message.alias("error_message"),
        F.when(~failed, F.to_json(details)).alias("validation_details"),
        F.current_timestamp().alias("timestamp"),
    )


def evaluate_sql(
    samples: DataFrame, responses: DataFrame, facts: dict[str, DataFrame], first_line_semicolon: bool = False
) -> DataFrame:
    """Execution plus unordered result similarity against the expected rows of each sample."""
    register_facts(facts)
    sql = extract_sql_block(F.col("content"), first_line_semicolon)
    answers = answered(samples, responses).withColumn("sql", sql)
    # The distinct (sample, statement) pairs are stored: what follows works on them, and the
    # answer texts are read again only for the result rows.
    asked = stored(answers.select("sample_id", clean_sql(F.col("sql")).alias("sql")).distinct(), "asked")
    status, rows = run_statements(asked, cleaned=True, tables=facts, numbered=False)
    ran = with_execution(answers, status)
    if "expected_result" in samples.columns:
        expects = F.coalesce(F.size("expected_result") > 0, F.lit(False))
        pairs = asked.select("sample_id", statement_id(F.col("sql"), cleaned=True).alias("sql_id"))
        pairs = pairs.join(status.where("status = 'ok'"), "sql_id")
        similarity = statement_similarity(pairs, rows, expected_rows(samples))
        ran = ran.join(similarity, ["sql_id", "sample_id"], "left")
    else:
        expects = F.lit(False)
        ran = ran.withColumn("similarity", F.lit(None).cast("double"))
    verdict = sql_verdict(F.col("executed"), expects, F.col("similarity"))
    scored = ran.withColumns(verdict)
    details = F.struct(
        F.col("sql").alias("extracted_sql"),
        "execution_score",
        "result_score",
        F.col("execution_message").alias("execution_details"),
        table_audit(F.col("sql")).alias("table_use"),
    )
    return result_row(scored, F.col("is_correct"), F.col("score"), details)


def evaluate_sql_targeted(samples: DataFrame, responses: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Same, where a semicolon on a statement's first line ends it."""
    return evaluate_sql(samples, responses, facts, first_line_semicolon=True)


def evaluate_sql_basic(samples: DataFrame, responses: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Ordered equality with the result of the sample's reference statement.

    Statements run as extracted: cleaning would change blanks and dashes inside literals.
    Only statements that start with SELECT yield rows to compare; any other that runs,
    such as one starting with WITH, equals just another of its kind.
    """
    register_facts(facts)
    answers = answered(samples, responses).withColumn("sql", extract_sql_basic(F.col("content")))
    has_reference = F.coalesce(F.length("ground_truth_sql") > 0, F.lit(False))
    asked = stored(
        answers.select(
            "sql",
            F.when(has_reference, F.col("ground_truth_sql")).alias("reference"),
        ).distinct(),
        "asked",
    )
    each = asked.select("sql").union(asked.select(F.col("reference").alias("sql")))
    status, rows = run_statements(each, cleaned=True, tables=facts)
    ran = with_execution(answers, status, cleaned=True).withColumn(
        "reference_id", F.when(has_reference, statement_id(F.col("ground_truth_sql"), cleaned=True))
    )
    reference = status.select(
        F.col("sql_id").alias("reference_id"), (F.col("status") == "ok").alias("reference_executed")
    )
    ran = ran.join(reference, "reference_id", "left")
    pairs = asked.select(
        statement_id(F.col("sql"), cleaned=True).alias("sql_id"),
        statement_id(F.col("reference"), cleaned=True).alias("reference_id"),
    ).na.drop()
    ran = ran.join(statement_equality(pairs, rows), ["sql_id", "reference_id"], "left")
    yields, reference_yields = [statement_kind(F.col(c)) == "rows" for c in ("sql", "ground_truth_sql")]
    ok = database_verdict(
        F.col("sql").isNotNull(),
        F.col("executed"),
        has_reference,
        F.col("reference_executed"),
        F.when(yields & reference_yields, F.col("is_equal")).otherwise(~yields & ~reference_yields),
    )
    details = F.struct(F.col("sql").alias("predicted_sql"), F.col("execution_message"))
    scored = ran.withColumn("ok", ok)
    return result_row(scored, F.col("ok"), F.col("ok").cast("double"), details)


def _with_calls(samples: DataFrame, responses: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    return answered(samples, responses).withColumn("predicted", extract(F.col("content")))


def _component_details() -> Column:
    return F.struct("selection", "parameters", "execution", "result", "predicted", "expected")


def evaluate_calls_executed(samples: DataFrame, responses: DataFrame, coverage: DataFrame, dedupe: bool = False) -> DataFrame:
    """Mean of four components; calls are run against the facts.

    The expected call follows from the question's wording; stored calls are not consulted.
    """
    df = _with_calls(samples, responses, lambda c: extract_calls_labelled(c, dedupe))
    df = with_requests(df.withColumn("expected", expected_calls(F.col("question"))))
    p, e = F.col("predicted"), F.col("expected")
    parts = df.withColumns(
        {
            "selection": scores.selection_exact(p, e),
            "parameters": scores.parameters_strict(p, e),
            "execution": execution_success(F.col("requests")),
        }
    )
    full = result_accuracy(parts, coverage)
    verdict = scores.mean_verdict(*[F.col(c) for c in ("selection", "parameters", "execution", "result")])
    scored = full.withColumns(verdict)
    return result_row(scored, F.col("is_correct"), F.col("score"), _component_details())


def evaluate_calls_catalogue(samples: DataFrame, responses: DataFrame, nested: bool = False) -> DataFrame:
    """Weighted components from the calls alone; a projection after the join of samples and answers."""
    df = _with_calls(samples, responses, lambda c: extract_calls_tiered(c, nested))
    df = scores.catalogue_scores(df.withColumnRenamed("expected_calls", "expected"))
    return result_row(df, F.col("is_correct"), F.col("score"), _component_details())


def evaluate_calls_matching(samples: DataFrame, responses: DataFrame, nested: bool = False) -> DataFrame:
    """Exact match of the calls, or the partial score of the best pairs."""
    df = _with_calls(samples, responses, lambda c: extract_calls_json_and_text(c, nested))
    df = scores.call_match(df.withColumnRenamed("expected_calls", "expected"))
    details = F.struct("is_exact", F.col("match_score").alias("similarity_score"), "predicted", "expected")
    return result_row(df, F.col("is_exact"), F.col("match_score"), details)


# All scorers by name; any ``(samples, responses, ...) -> results`` may be added.
EVALUATIONS: dict[str, Callable[..., DataFrame]] = {
    "sql": evaluate_sql,
    "sql_targeted": evaluate_sql_targeted,
    "sql_basic": evaluate_sql_basic,
    "calls_executed": evaluate_calls_executed,
    "calls_catalogue": evaluate_calls_catalogue,
    "calls_matching": evaluate_calls_matching,
}


def register_evaluation(name: str, evaluate: Callable[..., DataFrame]) -> None:
    EVALUATIONS[name] = evaluate


def analyze(results: DataFrame) -> dict[str, DataFrame]:
    """Every report table of one evaluation."""
    return {
        "overall_metrics": overall_metrics(results),
        "metrics_by_type": metrics_by(results, "evaluation_type"),
        "metrics_by_difficulty": metrics_by(results, "difficulty"),
        "detailed_breakdown": detailed_breakdown(results),
        "all_metrics": all_metrics(results),
        "error_rates": error_rates(results),
        "error_patterns": error_patterns(results),
    }


@dataclass(frozen=True)
class RunOptions:
    """What to evaluate and what to keep; counts of None take all samples, 0 takes none."""

    evaluation_type: str = "mixed"
    sql_samples: int | None = None
    function_samples: int | None = None
    difficulties: tuple[str, ...] = ()
    order: str = "pos"
    sql_scorer: str = "sql"
    function_scorer: str = "calls_executed"
    output_dir: str | None = None
    prefix: str = "evaluation"
    #: Samples that a run did not answer count as errors of that run.
    count_missing: bool = True

    def __post_init__(self) -> None:
        if self.evaluation_type not in EVALUATION_TYPES:
            raise ValueError(f"unknown evaluation type: {self.evaluation_type}")
        if any(n is not None and n < 0 for n in (self.sql_samples, self.function_samples)):
            raise ValueError("sample counts must not be negative")
        for name in (self.sql_scorer, self.function_scorer):
            if name not in EVALUATIONS:
                raise ValueError(f"unknown scorer: {name}")
        unknown = set(self.difficulties) - set(DIFFICULTIES)
        if unknown:
            raise ValueError(f"unknown difficulties: {sorted(unknown)}")


def chosen_samples(samples: DataFrame, options: RunOptions) -> DataFrame:
    """The samples a run covers; a full run takes every sample of the chosen difficulties."""
    full = options.evaluation_type == "full"
    counts = {"sql": options.sql_samples, "function": options.function_samples}
    sides = []
    for family in ("sql", "function"):
        wanted = family in EVALUATION_TYPES[options.evaluation_type]
        count = None if full else counts[family]
        sides.append((samples.where(F.col("evaluation_type") == family), count if wanted else 0))
    (sql, n_sql), (function, n_function) = sides
    return mixed_samples(sql, function, n_sql, n_function, list(options.difficulties), options.order)


def run_and_analyze(
    samples: DataFrame,
    responses: DataFrame,
    facts: dict[str, DataFrame],
    coverage: DataFrame,
    options: RunOptions | None = None,
) -> dict[str, DataFrame | dict[str, str]]:
    """Evaluate the chosen samples, aggregate, and store results where a folder is given.

    Results are stored before they are aggregated, so each answer is scored once. Samples without an
    answer are errors of every run in ``responses``, unless the options leave them out.
    """
    options = options or RunOptions()
    families = EVALUATION_TYPES[options.evaluation_type]
    chosen = chosen_samples(samples, options)
    parts = []
    for family, scorer in (("sql", options.sql_scorer), ("function", options.function_scorer)):
        if family in families:
            evaluate = EVALUATIONS[scorer]
            given = {"facts": facts, "coverage": coverage}
            asked = {k: v for k, v in given.items() if k in signature(evaluate).parameters}
            parts.append(evaluate(chosen.where(F.col("evaluation_type") == family), responses, **asked))
    if options.count_missing:
        parts.append(missing_results(chosen, responses))
    results = stored(reduce(lambda a, b: a.unionByName(b), parts), "results")
    out = {"results": results, **analyze(results)}
    if options.output_dir:
        out["saved_files"] = save_results(results, options.output_dir, options.prefix)
    return out
