"""Which samples were answered, as bit masks over numbered samples.

Samples are numbered inside hash buckets of about ``BUCKET``; sixty-four of them share a machine word. What a
run has answered, or got right, is one mask per word, so runs are compared with the sample set and with
each other by bit operations, on a sixty-fourth of the rows and without a window per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.session import stored

BUCKET = 4096
BITS = 64


def numbered(ids: DataFrame, sample: str = "sample_id") -> DataFrame:
    """``(sample, _bucket, _word, _bit)``: a place for every distinct sample; a null id is a sample, too."""
    distinct = stored(ids.select(sample).distinct(), "samples")
    buckets = max(1, -(-distinct.count() // BUCKET))
    bucket = F.pmod(F.xxhash64(sample), F.lit(buckets))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(sample)) - 1
    rows = distinct.withColumn("_bucket", bucket).withColumn("_place", place)
    word = F.col("_bucket") * (1 << 24) + F.floor(F.col("_place") / BITS)
    return stored(rows.select(sample, "_bucket", word.cast("bigint").alias("_word"), (F.col("_place") % BITS).cast("int").alias("_bit")), "numbered")


def _bit() -> Column:
    return F.expr("shiftleft(1L, _bit)")


def masks(rows: DataFrame, places: DataFrame, keys: list[str], flags: dict[str, Column], sample: str = "sample_id") -> DataFrame:
    """One row per ``keys`` and word; each flag's mask has the bits of the samples whose rows all hold it."""
    per_sample = rows.groupBy(*keys, sample).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    placed = per_sample.join(places.withColumnRenamed(sample, "_sample"), F.col(sample).eqNullSafe(F.col("_sample")))
    return placed.groupBy(*keys, "_word").agg(*[F.bit_or(F.when(F.col(n), _bit()).otherwise(F.lit(0).cast("bigint"))).alias(n) for n in flags])


def missing(samples: DataFrame, responses: DataFrame, keys: list[str], sample: str = "sample_id") -> DataFrame:
    """``(*keys, sample)`` of every sample that a run of ``responses`` lacks.

    A run is one combination of ``keys``; each is set against every word of samples, and only words with
    an absent bit are met with their samples.
    """
    places = numbered(samples, sample)
    present = masks(responses, places, keys, {"_present": F.lit(True)}, sample)
    packed = places.groupBy("_word").agg(F.collect_list(F.struct("_bit", F.col(sample).alias("_id"))).alias("_ids"))
    words = places.groupBy("_bucket", "_word").agg(F.bit_or(_bit()).alias("_all"))
    words = words.groupBy("_bucket").agg(F.collect_list(F.struct("_word", "_all")).alias("_words"))
    last = places.agg(F.max("_bucket")).first()[0]
    if last is None:
        return responses.select(*keys, sample).limit(0)
    # Every run with every bucket, one row each; a bucket's words are one bounded row.
    runs = responses.select(*keys).distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    asked = runs.join(words, "_bucket").select(*keys, F.explode("_words").alias("w")).select(*keys, "w._word", "w._all")
    same = [F.col(f"_p.{k}").eqNullSafe(F.col(f"_a.{k}")) for k in keys]
    held = asked.alias("_a").join(present.alias("_p"), [F.col("_p._word") == F.col("_a._word"), *same], "left")
    absent = F.col("_a._all").bitwiseAND(F.bitwise_not(F.coalesce("_p._present", F.lit(0).cast("bigint"))))
    gaps = held.select(*[F.col(f"_a.{k}").alias(k) for k in keys], F.col("_a._word").alias("_word"), absent.alias("_absent")).where("_absent <> 0")
    each = gaps.join(packed, "_word").select(*keys, "_absent", F.explode("_ids").alias("_s"))
    return each.where(F.expr("shiftright(_absent, _s._bit) & 1 = 1")).select(*keys, F.col("_s._id").alias(sample))


def pairwise_models(results: DataFrame, model: str = "model", sample: str = "sample_id") -> DataFrame:
    """Every two models on the samples that both answered, by counting bits.

    A model has a sample right when all its answers to it are. Pairs are ordered by name; models without
    a common sample give no row.
    """
    places = numbered(results, sample)
    flags = {"answered": F.lit(True), "right": F.col("is_correct")}
    each = stored(masks(results, places, [model], flags, sample), "masks")
    a = each.select("_word", F.col(model).alias("model_a"), F.col("answered").alias("in_a"), F.col("right").alias("a"))
    b = each.select("_word", F.col(model).alias("model_b"), F.col("answered").alias("in_b"), F.col("right").alias("b"))
    both = a.join(b, "_word").where("model_a < model_b")

    def bits(expression: str) -> Column:
        return F.sum(F.expr(f"bit_count(in_a & in_b & {expression})")).cast("bigint")

    counts = both.groupBy("model_a", "model_b").agg(
        bits("-1L").alias("common_samples"),
        bits("a & b").alias("both_right"),
        bits("a & ~b").alias("only_a_right"),
        bits("~a & b").alias("only_b_right"),
    )
    lead = F.round((F.col("only_a_right") - F.col("only_b_right")) / F.col("common_samples"), 6)
    return counts.where("common_samples > 0").withColumn("lead_of_a", lead)
