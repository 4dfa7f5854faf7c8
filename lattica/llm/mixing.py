"""Operator 9, mixing sources to target weights: Poisson replication.

A source's target repetition rate is what its target weight makes of its bytes.
Each document inverts a Poisson distribution of that mean at a uniform number
from a seeded hash of its id, is repeated as often as that says, and the copies
are shuffled globally by another hash. Rows without an id, and rows that share
one, draw each on its own: by what they hold and by their number among equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.rows import named
from lattica.session import materialize, table

SEED = 20_260
#: Default target weights: bytes of a source to this power, normed. 1 keeps the mixture, 0 makes sources equal.
EXPONENT = 0.5
#: Rows of the table of sources up to which it's broadcast (a row is under 1 kB); beyond, a salted join.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: A mean is inverted in steps of at most this: a Poisson number of mean a + b is the sum of two.
STEP = 8.0
#: Terms of the distribution of one step; what is beyond has a probability below 1e-15.
TERMS = 48
#: Digits of the hash that make a uniform number (52 bits, exact as a double).
_HEX = 13


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the parts' MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**_HEX))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = EXPONENT, size: float = 1.0) -> DataFrame:
    """source, bytes, weight and rate for each source of docs (source, text), over all rows.

    `weights` names target weights (normed over the sources there are; others
    get 0); without it they follow `exponent`. The result aims at `size` times
    the bytes there are. A null source is a source; a row counts its bytes plus 1.
    """
    bytes_ = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1
    by = docs.groupBy("source").agg(F.sum(bytes_).alias("bytes"))
    if weights is None:
        raw = F.pow(F.col("bytes").cast("double"), F.lit(float(exponent)))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    # one row a source
    total = by.agg(F.sum("bytes").alias("all_bytes"), F.sum(raw).alias("all_raw"))
    weight = F.when(F.col("all_raw") > 0, raw / F.col("all_raw")).otherwise(F.lit(0.0))
    rated = by.crossJoin(F.broadcast(total)).withColumn("weight", weight)
    return rated.select("source", "bytes", "weight", (F.lit(float(size)) * F.col("weight") * F.col("all_bytes") / F.col("bytes")).alias("rate"))


def _cumulative(mean: Column) -> Column:
    """The distribution function of a Poisson number at 0, 1, ... TERMS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["c"]


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = EXPONENT, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, source and any other columns), each as often as drawn, in a global shuffle.

    Keeps the columns and adds copy (from 0) and shuffle_key. The draw depends on
    the seed, the doc_id and the source's rate alone. Rows with a null doc_id, or
    with one that other rows have too, draw each on its own (`rows.named`), so a
    third of all rows may lack an id. Null texts are rows like others. Columns
    of docs named copy or shuffle_key are replaced; such of a map type can't be
    compared, so they are allowed only where ids are unique. An empty table gives none.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rates = materialize(source_rates(docs, weights, exponent, size), "rates")
    steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))
    plan = rates.select(F.col("source").alias("__source"), steps.alias("__steps"), _cumulative(F.col("rate") / steps).alias("__cdf"))
    rows = named(docs.select(*[F.col(f"`{c}`") for c in kept]))
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source")))
    else:
        salt = F.pmod(F.xxhash64("__who"), F.lit(SALTS)).cast("int")
        spread = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = rows.withColumn("__of", salt)
        joined = left.join(spread, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__of") == F.col("__salt")))

    def draw(k: Column) -> Column:
        u = _uniform(F.lit(str(seed)), F.col("__who"), k.cast("string"))
        return F.size(F.filter("__cdf", lambda c: c < u))

    n = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__steps")), draw), F.lit(0), lambda a, b: a + b)
    # the hash is evaluated once a row, before rows are repeated
    copies = joined.withColumn("__n", n).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.col("__who"), F.col("copy").cast("string")))
    mixed = copies.select(*[F.col(f"`{c}`") for c in kept], "copy", key.alias("shuffle_key"))
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartition(partitions, "shuffle_key").sortWithinPartitions("shuffle_key")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to square-root weights: one row a copy."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", F.octet_length("text").cast("long").alias("n_bytes"), "shuffle_key")


#: Names rows as `rows.named` does; documents has the columns doc_id, text, lang, source, n_chars.
OP9_SQL = f"""
WITH RECURSIVE o AS (SELECT doc_id, text, lang, source, n_chars, count(*) OVER (PARTITION BY doc_id) AS of_id,
    row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1 AS place FROM documents),
w AS (SELECT doc_id, text, source, CASE WHEN doc_id IS NOT NULL AND of_id = 1 THEN doc_id::VARCHAR ELSE concat_ws('|', coalesce(doc_id::VARCHAR, ''),
    md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(n_chars::VARCHAR, chr(0)))), place::VARCHAR) END AS who FROM o),
s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS b FROM documents GROUP BY source),
t AS (SELECT sum(b)::DOUBLE AS tb, sum(pow(b::DOUBLE, {EXPONENT})) AS tr FROM s),
r AS (SELECT source, 1.0 * (pow(b::DOUBLE, {EXPONENT}) / tr) * tb / b AS rate FROM s, t),
q AS (SELECT source, greatest(1, ceil(rate / {STEP}))::INT AS steps, rate / greatest(1, ceil(rate / {STEP})) AS mean FROM r),
c AS (SELECT source, steps, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cum FROM q
      UNION ALL SELECT source, steps, mean, k + 1, p * mean / (k + 1), cum + p * mean / (k + 1) FROM c WHERE k < {TERMS - 1}),
d AS (SELECT who, doc_id, source, text, unnest(range(1, steps + 1)) AS step FROM (SELECT who, doc_id, w.source, text, steps FROM w JOIN q ON w.source IS NOT DISTINCT FROM q.source)),
u AS (SELECT who, doc_id, source, text, step,
        (('0x' || substr(md5('{SEED}|' || who || '|' || step::VARCHAR), 1, {_HEX}))::BIGINT::DOUBLE + 0.5) / {float(16**_HEX)!r} AS u FROM d),
n AS (SELECT who, any_value(doc_id) AS doc_id, any_value(u.source) AS source, any_value(text) AS text, count(c.k) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cum < u.u GROUP BY who),
e AS (SELECT who, doc_id, source, text, unnest(range(0, n::BIGINT)) AS copy FROM n)
SELECT doc_id, source, copy::INT AS copy, strlen(text)::BIGINT AS n_bytes, md5('{SEED}s|' || who || '|' || copy::VARCHAR) AS shuffle_key FROM e
"""
