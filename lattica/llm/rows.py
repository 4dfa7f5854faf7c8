"""Names for rows that draw by chance: repeatable, and apart for rows that have no id or share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize

#: Equal rows that one task makes anew from their count.
REPEAT_BLOCK = 4_096


def _row_digest(columns: list[str]) -> Column:
    """MD5 of a row's columns as text."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]))


def named(docs: DataFrame) -> DataFrame:
    """The rows of docs with `__who`, by which they draw: the doc_id where it stands once, else a name of each row's own.

    Rows with a null or repeated id are named by the id, a digest of the whole
    row and their number among equal rows. Equal rows can't be told apart, so
    they are counted (combined before the shuffle, whatever their number) and
    made anew in blocks; the names are the same in every run.
    """
    plain = docs.withColumn("__who", F.col("doc_id").cast("string"))
    ids = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    odd = materialize(ids.filter("__n > 1 or __id is null").select("__id"), "odd_ids")
    if odd.isEmpty():
        return plain
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    counted = docs.join(odd, same, "left_semi").groupBy(*[F.col(f"`{c}`") for c in docs.columns]).agg(F.count("*").alias("__n"))
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {REPEAT_BLOCK}"))).alias("__block")
    digest = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _row_digest(docs.columns)).alias("__digest")
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = counted.select("*", digest, block).repartition(partitions, "__digest", "__block")
    first = F.col("__block") * REPEAT_BLOCK
    numbered = blocks.withColumn("__at", F.explode(F.sequence(first, F.least(first + REPEAT_BLOCK, F.col("__n")) - 1)))
    named = numbered.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat_ws("|", "__digest", F.col("__at").cast("string")).alias("__who"))
    return plain.join(odd, same, "left_anti").unionByName(named)
