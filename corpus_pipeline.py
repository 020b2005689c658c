"""From raw documents to packed training sequences, by the operators of ``tallywright.llm``.

Every stage is ``(name, function)``; a function takes the session, the documents that the stage
before has kept and the folder of the tables. All but the last return the columns of
``documents``; each result is written and read again before the next stage. An empty table, null ids or texts
and repeated rows are handled as the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import domain_mixing, minhash, packing, quality_rules, toxicity
from tallywright.llm.queries import tokenizer_path
from tallywright.llm.registry import ship, spread, table
from tallywright.session import stored

#: Shares of languages are flattened by this power of what the documents hold.
TEMPER = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    ship(spark)
    return toxicity.without_toxic(spread(docs), toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    ship(spark)
    return quality_rules.without_failed(spread(docs), quality_rules.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    ship(spark)
    return minhash.one_of_each(docs, 5, 80, spread)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, some more than once, at rates that bring the languages' expected tokens to their targets.

    The rows of ``labels`` name the documents whose language tag teaches the classifier.
    """
    taught = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    mixed, _ = domain_mixing.mix(docs, taught.select("doc_id", F.col("lang").alias("domain")), temper=TEMPER)
    return domain_mixing.draw_copies(mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    ship(spark)
    return packing.pack(spread(docs), tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("minhash", drop_near_copies),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: The trained stages and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
