"""Operator 1, sharding: a two-pass external shuffle in DataFrame operations only.

Pass one scatters records over memory-sized buckets by a seeded hash. Pass two
reads one bucket a task, applies a Fisher-Yates permutation to its positions and
writes it. Buckets stand one after another in a global order, and that order is
cut into shards whose row counts differ by one at most (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.rows import named
from lattica.session import scratch, table

#: UTF-8 bytes of text that one bucket holds on average; what a task sorts in memory.
BUCKET_BYTES = 32 << 20
#: Of the bucket's seeded hash, and of the permutations.
SEED = 20_260


def _sized(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "__who", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))


def shuffle_shards(
    docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Writes the rows of docs (doc_id, text) as shards below `path` and returns them as read back.

    Columns: doc_id, text, bucket, shard, slot. Every row is written once: null
    ids and null texts are records like others, repeated rows are kept as many
    times as they occur, and an empty table gives an empty result. Columns other
    than doc_id and text are left behind. Equal texts have no bearing on the
    place: the hash takes doc_id and text, so copies under different ids scatter,
    and rows without an id, or that share one, scatter too (`rows.named`).
    """
    spark = docs.sparkSession
    rows = _sized(named(docs.select("doc_id", "text")))
    total = rows.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "__who", F.xxhash64("text")), F.lit(buckets)).cast("int")
    placed = rows.select("doc_id", "text", "__who", bucket.alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    ends = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    # one row a bucket: the table of buckets stays small against the rows (one for each 32 MB)
    plan = counts.select("bucket", "n", (ends - F.col("n")).alias("first"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    perm = (
        plan.repartitionById(buckets, "bucket")
        .withColumn("perm", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)))
    )
    order = W.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "__who"), "__who")
    dealt = (
        placed.repartitionById(buckets, "bucket")
        .withColumn("at", F.row_number().over(order) - 1)
        # merged, not broadcast: a permutation holds a number for each row, and one stands at a bucket's side at a time
        .join(perm.hint("merge"), "bucket")
        .withColumn("rank", F.col("first") + F.element_at("perm", (F.col("at") + 1).cast("int")))
        # shard s holds the ranks from floor(s * total / shards) on
        .withColumn("shard", F.expr(f"((rank + 1) * {shards} - 1) div total").cast("int"))
        .withColumn("slot", F.expr(f"rank - (shard * total) div {shards}"))
        .select("doc_id", "text", "bucket", "shard", F.col("slot").cast("long").alias("slot"))
        .sortWithinPartitions("shard", "slot")
    )
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = "doc_id long, text string, bucket int, slot long, shard int"
    return spark.read.schema(schema).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `rows`, from the written shards.

    A null text has no bytes: size 1, crc 0.
    """
    out = shuffle_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "bucket",
    )
