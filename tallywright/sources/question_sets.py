"""Question sets: read, normalise, filter, cut and combine.

A set is one JSON document per file, or one per line, with its questions in a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.call_text import calls_from_items, no_calls
from tallywright.functions.questions import normal_difficulty
from tallywright.session import configure

_CALL = "struct<name:string,function_name:string,arguments:variant,parameters:variant>"
_TOOL = "struct<name:string,description:string>"
# Every key under which a field may appear, in any of the three kinds of set.
_ITEM = (
    "struct<question_id:string,question_text:string,question:string,difficulty:variant,"
    "reference_sql:string,ground_truth_sql:string,sql:string,context:string,"
    "category:string,complexity:string,workflow_type:string,"
    "expected_result:array<map<string,variant>>,ground_truth_results:variant,"
    f"function_sequence:array<{_CALL}>,ground_truth_functions:array<{_CALL}>,"
    f"expected_functions:array<{_CALL}>,available_functions:array<{_TOOL}>>"
)
DOCUMENT = (
    f"struct<questions:array<{_ITEM}>,ground_truth_data:array<{_ITEM}>,"
    f"available_functions:array<{_TOOL}>>"
)


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Question documents as a column ``doc``; many files are read in parallel.

    ``document`` names each one where there are several, so that made ids differ and file order is known; it
    is null for a single file with one document.
    """
    schema = T.StructType.fromDDL(f"doc {DOCUMENT}")["doc"].dataType
    raw = configure(spark).read.schema(schema).json(path, multiLine=not one_per_line)
    file = F.col("_metadata.file_name")
    if one_per_line:
        name = F.format_string("%s:%012d", file, F.monotonically_increasing_id())
    else:
        name = F.lit(None).cast("string") if len(raw.inputFiles()) == 1 else file
    return raw.select(name.alias("document"), F.struct(*schema.fieldNames()).alias("doc"))


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """Same from a text column that holds one document per row."""
    configure(df.sparkSession)
    return df.withColumn("doc", F.from_json(text, DOCUMENT)).drop(text)


def _items(df: DataFrame, items: Column) -> DataFrame:
    keep = [c for c in df.columns if c != "doc"]
    return df.select(*keep, "doc", F.posexplode(items).alias("pos", "item"))


def _text(value: Column) -> Column:
    """The text of a JSON value if it is a string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _calls(items: Column) -> Column:
    return F.coalesce(calls_from_items(items), no_calls())


def _made_id(df: DataFrame, prefix: str) -> Column:
    """An id from the place in the list, with the document's name where there are several."""
    here = F.col("pos").cast("string")
    if "document" in df.columns:
        here = F.concat_ws("_", "document", here)
    return F.concat(F.lit(prefix), here)


def _samples(df: DataFrame, sample_id: Column, kind: str, question: Column, **fields: Column) -> DataFrame:
    item = F.col("item")
    keep = [c for c in df.columns if c not in ("doc", "item")]
    return df.select(
        *keep,
        sample_id.alias("sample_id"),
        question.alias("question"),
        F.lit(kind).alias("evaluation_type"),
        normal_difficulty(_text(item["difficulty"])).alias("difficulty"),
        item["context"].alias("context"),
        *[v.alias(k) for k, v in fields.items()],
    )


def sql_samples(documents: DataFrame) -> DataFrame:
    """Samples of a SQL question set; a missing id is made from the position in the list."""
    item, doc = F.col("item"), F.col("doc")
    df = _items(documents, F.coalesce(doc["questions"], doc["ground_truth_data"]))
    return _samples(
        df,
        F.coalesce(item["question_id"], _made_id(df, "sql_")),
        "sql",
        F.coalesce(item["question_text"], item["question"], F.lit("")),
        ground_truth_sql=F.coalesce(
            item["reference_sql"], item["ground_truth_sql"], item["sql"], F.lit("")
        ),
        category=item["category"],
        complexity=item["complexity"],
        expected_result=item["expected_result"],
    )


def function_samples(documents: DataFrame) -> DataFrame:
    """Samples of a function question set, with expected calls and the functions on offer."""
    item, doc = F.col("item"), F.col("doc")
    df = _items(documents, F.coalesce(doc["questions"], doc["ground_truth_data"]))
    return _samples(
        df,
        F.coalesce(item["question_id"], _made_id(df, "func_")),
        "function",
        F.coalesce(item["question_text"], item["question"], F.lit("")),
        expected_calls=_calls(
            F.coalesce(item["function_sequence"], item["ground_truth_functions"])
        ),
        available_functions=F.coalesce(
            doc["available_functions"],
            item["available_functions"],
            F.array().cast(f"array<{_TOOL}>"),
        ),
        category=item["category"],
        workflow_type=item["workflow_type"],
    )


def catalogue_samples(documents: DataFrame) -> DataFrame:
    """Samples of a set whose functions are the fixed catalogue; ids get the prefix ``fcl_``."""
    item, doc = F.col("item"), F.col("doc")
    df = _items(documents, doc["questions"])
    return _samples(
        df,
        F.concat(F.lit("fcl_"), F.coalesce(item["question_id"], _made_id(df, ""))),
        "function",
        F.coalesce(item["question"], F.lit("")),
        expected_calls=_calls(item["expected_functions"]),
        category=F.coalesce(item["category"], F.lit("discovery")),
        ground_truth_results=F.to_json(item["ground_truth_results"]),
    )


def filter_difficulty(samples: DataFrame, difficulties: list[str] | None) -> DataFrame:
    """Keep the listed difficulties; an empty or missing list keeps all."""
    if not difficulties:
        return samples
    return samples.where(F.col("difficulty").isin(*difficulties))


def first_samples(samples: DataFrame, n: int | None, order: str = "pos", per: str | None = None) -> DataFrame:
    """The first ``n`` samples in file order, over all or per value of ``per``; None or 0 keeps all.

    Where samples come from several files, the file goes before ``order``. The values of ``per``, a
    short list such as families or difficulties, are each cut by a sort and a limit, which
    no one task has to do for a whole group.
    """
    if not n:
        return samples
    by = [c for c in ("document",) if c in samples.columns and c != order] + [order]
    if per is None:
        return samples.orderBy(*by).limit(n)
    values = [r[0] for r in samples.select(per).distinct().collect()]
    parts = [samples.where(F.col(per).eqNullSafe(F.lit(v))).orderBy(*by).limit(n) for v in values]
    return reduce(DataFrame.unionByName, parts) if parts else samples


def mixed_samples(
    sql: DataFrame,
    function: DataFrame,
    sql_count: int | None = None,
    function_count: int | None = None,
    difficulties: list[str] | None = None,
    order: str = "pos",
) -> DataFrame:
    """SQL samples followed by function samples; a count of 0 leaves a side out, None takes all."""
    sides = [(sql, sql_count), (function, function_count)]
    parts = [
        first_samples(filter_difficulty(df, difficulties), n, order) for df, n in sides if n != 0
    ]
    if not parts:
        return sql.limit(0).unionByName(function.limit(0), allowMissingColumns=True)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dataset_info(samples: DataFrame, set_name: str = "evaluation_type", file: str | None = None) -> DataFrame:
    """Number of questions per set, and per file where the file is known."""
    keys = [set_name] + ([file] if file else [])
    return samples.groupBy(*keys).agg(F.count("*").alias("total_questions"))
