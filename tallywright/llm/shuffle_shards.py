"""A uniform shuffle into shards in two passes, with DataFrame functions only.

First pass: a seeded hash scatters whole records into buckets that fit in memory. Second pass:
each bucket is put in order of the hash and shuffled (Spark's ``shuffle`` is a Fisher-Yates shuffle), and
written. The shuffled buckets, one after another, are a uniform order of all records; dealing
them out in turn gives shards whose counts differ by one at most (the law ``rows``).

A bucket holds about ``BUCKET_BYTES`` whatever the input's size: the number of buckets follows
the total size. The hash covers the row's place in the stored input, so equal ids, sources or texts do not
meet in one bucket. Defined cases: a null text has size 1 and the checksum of the empty text;
null ids and repeated rows are records like any other; an empty table gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import stored

BUCKET_BYTES = 8 << 20
RUN = 4096  # buckets
LAW = "rows"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def shuffled(df: DataFrame, text: str = "text", seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records in a uniform order, written: columns ``bucket``, ``place`` and ``record``."""
    total = df.agg(F.sum(record_size(F.col(text)) + 64)).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    records = df.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    records = records.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(buckets)).cast("bigint"))
    # A fixed number of tasks, one bucket or few each: the shuffle's draws depend on the task.
    gathered = records.repartition(buckets, "bucket").groupBy("bucket")
    ordered = gathered.agg(F.sort_array(F.collect_list(F.struct("key", "record"))).alias("all"))
    dealt = ordered.select("bucket", F.posexplode(F.shuffle("all", seed)).alias("place", "item"))
    return stored(dealt.select("bucket", F.col("place").cast("bigint").alias("place"), "item.record"), "shuffled")


def shards(df: DataFrame, n_shards: int = 8, text: str = "text", seed: int = 20) -> DataFrame:
    """Every record with its ``shard`` and its ``slot`` there, under the law ``rows``.

    Returns ``record`` (all columns of ``df``), ``shard`` int and ``slot`` long.
    """
    rows = shuffled(df, text, seed)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # Offsets of all buckets: sums inside a run of buckets, and of the runs before, of which there are few.
    counts = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    first = (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first")
    offsets = stored(counts.join(runs, "run").select("bucket", first), "offsets")
    index = F.col("first") + F.col("place")
    placed = rows.join(offsets, "bucket").withColumn("index", index)
    return placed.select("record", F.pmod("index", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("index") / n_shards).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int = 8, text: str = "text", seed: int = 20, pieces: int = 1) -> None:
    """Write the shards as folders ``shard=0`` and so on, each in order of its slots.

    A shard is written by ``pieces`` tasks, a range of slots each.
    """
    rows = shards(df, n_shards, text, seed)
    rows = rows.select("record.*", "shard", "slot").repartitionByRange(n_shards * pieces, "shard", "slot")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(df: DataFrame, n_shards: int = 8, seed: int = 20) -> DataFrame:
    """Shard and slot of every document, with size and checksum of its text."""
    rows = shards(df.select("doc_id", "text"), n_shards, "text", seed)
    text = F.col("record.text")
    return rows.select(
        F.col("record.doc_id").alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
