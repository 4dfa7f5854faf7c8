"""Baseline edge selectors: degree-based sampling and locality-sensitive hashing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators.graph import bidirectional, degrees
from lattica.session import stored

#: Fixed value of the minimum hash: a prime.
PRIME = 2_147_483_647
#: Fixed value: the sampler's seed, whatever the caller's.
SAMPLER_SEED = 42


def sample_budget(nodes: int, epsilon: float) -> int:
    """Samples with replacement; none for fewer than two nodes; an epsilon of 0 or less is an error."""
    if epsilon <= 0:
        raise ValueError("epsilon has to be positive")
    return 0 if nodes <= 1 else int(0.16 * nodes * math.log(nodes) / epsilon**2)


def edge_probabilities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, p: proportional to 1 / degree(u) + 1 / degree(v)."""
    d = degrees(nodes, edges)
    j = edges.select("u", "v").join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    r = j.select("u", "v", (1.0 / F.col("du") + 1.0 / F.col("dv")).alias("r"))
    return r.crossJoin(F.broadcast(r.agg(F.sum("r").alias("total")))).select("u", "v", (F.col("r") / F.col("total")).alias("p"))


def cumulative(probabilities: DataFrame) -> DataFrame:
    """u, v, p, lo, hi: intervals of the distribution function in edge order."""
    hi = F.sum("p").over(W.orderBy("u", "v").rowsBetween(W.unboundedPreceding, W.currentRow))
    return probabilities.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("p"))


def sample_edges(cdf: DataFrame, uniforms: DataFrame) -> DataFrame:
    """u, v, p, samples: how many of uniforms(x) fall into each edge's interval (lo < x <= hi); beyond the end the last edge.

    Both sides meet in slots of equal width, as many as there are edges: an
    interval spans two slots on average, so rows don't grow faster than edges.
    """
    width = max(1024, cdf.count())
    slot = lambda c: F.floor(F.least(c, F.lit(1.0 - 1e-12)) * width).cast("long")
    last = cdf.agg(F.max("hi").alias("end"))
    x = uniforms.crossJoin(F.broadcast(last)).select(F.least("x", "end").alias("x"))
    spread = cdf.withColumn("slot", F.explode(F.sequence(slot(F.greatest("lo", F.lit(0.0))), slot(F.col("hi")))))
    hit = spread.join(x.withColumn("slot", slot(F.col("x"))), "slot").filter("x > lo and x <= hi")
    return hit.groupBy("u", "v", "p").agg(F.count("*").alias("samples"))


def uniforms(spark: SparkSession, rng: np.random.RandomState, start: int, stop: int, held: tuple[bytes, int, int] | None = None, chunk: int = 1 << 20) -> DataFrame:
    """k and x: uniforms start .. stop - 1 of a stream that stands at `start`, and stands at `stop` afterwards.

    The driver only runs through the stream, a block at a time, and notes the
    generator's state at each chunk; tasks draw the chunks. `held`: packed bits,
    slots and slots a bit; a uniform is left out if the bit of its slot isn't set.
    """
    chunk, block = max(chunk, (stop - start) // 4096), 1 << 16
    states = []
    for first in range(start, stop, chunk):
        n = min(chunk, stop - first)
        _, keys, place, *_ = rng.get_state()
        states.append((first, n, int(place), bytearray(keys.tobytes())))
        for k in range(0, n, block):
            rng.random_sample(min(block, n - k))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if held is None else np.unpackbits(np.frombuffer(held[0], np.uint8)).astype(bool)
        for batch in batches:
            for s in batch.to_pylist():
                own = np.random.RandomState()
                own.set_state(("MT19937", np.frombuffer(s["keys"], np.uint32), s["place"]))
                for k in range(0, s["n"], block):
                    x = own.random_sample(min(block, s["n"] - k))
                    at = np.arange(s["first"] + k, s["first"] + k + len(x))
                    if wanted is not None:
                        take = wanted[np.floor(np.minimum(x, 1.0 - 1e-12) * held[1]).astype(np.int64) // held[2]]
                        x, at = x[take], at[take]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(x)], ["k", "x"])

    rows = spark.createDataFrame(states, "first long, n long, place int, keys binary")
    return rows.repartition(max(1, min(len(states), 1024))).mapInArrow(draw, "k long, x double")


def first_draws(cdf: DataFrame, total: int, spans: int = 4, bits: int = 1 << 20) -> Callable[[int], DataFrame]:
    """Gives u, v and first for a budget: the first uniform that draws an edge, for every edge that so many uniforms draw (and perhaps some drawn later).

    cdf: stored u, v, lo, hi of `total` edges. The stream is read once, in
    stretches of doubling length. Only edges not drawn yet go on, and only
    uniforms whose slots such an edge still touches are dealt: later draws of
    an edge don't change its first. None is left out otherwise.
    """
    spark, width = cdf.sparkSession, max(1024, total)
    ratio = -(-width // bits)
    slot = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0 - 1e-12)) * width).cast("long")
    end = cdf.agg(F.max("hi")).first()[0] if total else 0.0
    spread = lambda df: df.withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    rng = np.random.RandomState(SAMPLER_SEED)
    at, left, open_edges, found = 0, cdf.select("u", "v", "lo", "hi"), total, []

    def firsts(budget: int) -> DataFrame:
        nonlocal at, left, open_edges
        while at < budget and open_edges:
            stop, held = min(budget, max(spans * total, 2 * at)), None
            if found:
                touched = spread(left).select((F.col("slot") / ratio).cast("long").alias("s")).distinct().toArrow().column("s").to_numpy()
                mark = np.zeros(-(-width // ratio), bool)
                mark[touched] = True
                mark[int(min(end, 1.0 - 1e-12) * width) // ratio :] = True  # uniforms beyond the end draw the last edge
                held = (np.packbits(mark).tobytes(), width, ratio)
            x = uniforms(spark, rng, at, stop, held).select("k", F.least("x", F.lit(end)).alias("x"))
            hit = spread(left).join(x.withColumn("slot", slot(F.col("x"))), "slot").filter("x > lo and x <= hi")
            found.append(stored(hit.groupBy("u", "v").agg(F.min("k").alias("first")), "first"))
            left = stored(left.join(found[-1], ["u", "v"], "left_anti"), "undrawn")
            at, open_edges = stop, left.count()
        out = cdf.select("u", "v", F.lit(0).cast("long").alias("first")).limit(0) if not found else found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    return firsts


def dspar(nodes: DataFrame, edges: DataFrame, epsilon: float) -> DataFrame:
    """u, v, weight of the sampled edges; weight is samples / budget / p. Uniforms come from one seeded stream, as the sampler is sequential."""
    spark = edges.sparkSession
    budget = sample_budget(nodes.count(), epsilon)
    x = uniforms(spark, np.random.RandomState(SAMPLER_SEED), 0, budget).select("x")
    return sample_edges(cumulative(edge_probabilities(nodes, edges)), x).select("u", "v", (F.col("samples") / F.lit(float(max(budget, 1))) / F.col("p")).alias("weight"))


def lsh_dims(dims: int, sparsity: float) -> int:
    """Dimensions that a hash looks at: a count above 1, else a share rounded to even, within 1 and dims."""
    n = int(sparsity) if sparsity > 1 else round(dims * sparsity)
    return max(1, min(dims, n))


def edge_positions(edges: DataFrame) -> DataFrame:
    """u, v and pos: a node's neighbours above it ascending, then those below it ascending."""
    two = bidirectional(edges.select("u", "v"))
    return two.withColumn("pos", F.row_number().over(W.partitionBy("u").orderBy(F.when(F.col("v") > F.col("u"), 0).otherwise(1), "v")))


def edge_features(edges: DataFrame, features: DataFrame) -> DataFrame:
    """u, v, pos and x: both ends' features (node, features), the edge's own node first."""
    f = features.select("node", F.col("features").cast("array<double>").alias("f"))
    j = edge_positions(edges).join(f.toDF("u", "fu"), "u").join(f.toDF("v", "fv"), "v")
    return j.select("u", "v", "pos", F.concat("fu", "fv").alias("x"))


def projection_hashes(rows: DataFrame, planes: list[tuple[list[int], list[float], float]], step: float) -> DataFrame:
    """Adds h: for each plane (dimensions, coefficients, bias) the floor of (x[dimensions] . coefficients + bias) / step."""

    def one(dims: list[int], plane: list[float], bias: float):
        dot = F.lit(float(bias))
        for d, c in zip(dims, plane):
            dot = dot + F.col("x")[d] * F.lit(float(c))
        return F.floor(dot / F.lit(float(step))).cast("long")

    return rows.withColumn("h", F.array(*[one(*p) for p in planes]))


def permutation_hashes(rows: DataFrame, column: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Adds h: (a * value + b) mod the prime for each pair."""
    return rows.withColumn("h", F.array(*[(F.lit(a).cast("long") * F.col(column) + F.lit(b).cast("long")) % F.lit(PRIME) for a, b in pairs]))


def threshold_signature(rows: DataFrame, dims: list[int], thresholds: list[float]) -> DataFrame:
    """Adds signature: a bit for each dimension whose value is at most its threshold, and its token by MD5."""
    bits = [F.when(F.col("x")[d] <= F.lit(float(t)), "1").otherwise("0") for d, t in zip(dims, thresholds)]
    s = rows.withColumn("signature", F.concat(*bits))
    return s.withColumn("token", (F.conv(F.substring(F.md5("signature"), 1, 8), 16, 10).cast("long") % F.lit(PRIME)))


def select_winners(hashed: DataFrame, k: int) -> DataFrame:
    """u, v: for each node and function 1 .. k the neighbour with the least (hash, position) not taken before."""
    left, won = hashed, None
    for f in range(k):
        best = left.groupBy("u").agg(F.min(F.struct(F.col("h")[f].alias("h"), "pos", "v")).alias("b")).select("u", F.col("b.v").alias("v"))
        won = best if won is None else won.unionByName(best)
        left = left.join(best, ["u", "v"], "left_anti")
    return won


def random_planes(dims: int, k: int, sparsity: float, seed: int) -> list[tuple[list[int], list[float], float]]:
    """Planes of a random projection: coefficients, then biases (normal both), then dimensions with replacement, from one seeded stream."""
    rng, n = np.random.RandomState(seed), lsh_dims(dims, sparsity)
    planes = rng.standard_normal((k, n))
    biases = rng.standard_normal(k)
    chosen = [rng.randint(0, dims, n) for _ in range(k)]
    return [(c.tolist(), p.tolist(), float(b)) for c, p, b in zip(chosen, planes, biases)]


def random_thresholds(dims: int, k: int, sparsity: float, seed: int) -> tuple[list[tuple[int, int]], list[int], list[float]]:
    """Of one seeded stream: k pairs of the minimum hash, then for each of k functions dimensions without replacement and their thresholds, normal around 1."""
    rng, n = np.random.RandomState(seed), lsh_dims(dims, sparsity)
    pairs = [(int(rng.randint(0, PRIME)), int(rng.randint(0, PRIME))) for _ in range(k)]
    chosen, thresholds = [], []
    for _ in range(k):
        chosen += rng.permutation(dims)[:n].tolist()
        thresholds += (rng.normal(0.0, 1.0, n) + 1.0).tolist()
    return pairs, chosen, thresholds


def lsp(edges: DataFrame, features: DataFrame, dims: int, k: int, sparsity: float, step: float | None, seed: int = 0, variant: str = "p") -> DataFrame:
    """Canonical edges that some node selects under k random projections (variant p), or k minimum hashes of threshold signatures (variant t, without a step)."""
    from lattica.operators.graph import canonical_edges

    if k <= 0 or sparsity <= 0:
        raise ValueError("k and sparsity have to be positive")
    rows = edge_features(edges, features)
    if variant == "p":
        hashed = projection_hashes(rows, random_planes(2 * dims, k, sparsity, seed), step)
    elif variant == "t":
        pairs, chosen, thresholds = random_thresholds(dims, k, sparsity, seed)
        hashed = permutation_hashes(threshold_signature(rows, chosen + [dims + d for d in chosen], thresholds * 2), "token", pairs)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return canonical_edges(select_winners(hashed, k))


def _hashes(x: np.ndarray, dims: int, variant: str, k: int, n: int, step: float | None, seed: int) -> list[np.ndarray]:
    """The k hashes of rows x, as `projection_hashes` and `permutation_hashes` give them."""
    if variant == "p":
        out = []
        for chosen, plane, bias in random_planes(2 * dims, k, n / (2 * dims), seed):
            dot = np.full(len(x), bias)
            for d, c in zip(chosen, plane):
                dot = dot + x[:, d] * c
            out.append(np.floor(dot / step).astype(np.int64))
        return out
    pairs, chosen, thresholds = random_thresholds(dims, k, n / dims, seed)
    bits = np.packbits(x[:, chosen + [dims + d for d in chosen]] <= np.array(thresholds * 2), axis=1)
    held, of = np.unique(bits, axis=0, return_inverse=True)
    words = ["".join(map(str, np.unpackbits(b)[: 2 * len(chosen)])) for b in held]
    token = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % PRIME for w in words], np.int64)[of.reshape(-1)]
    return [(a * token + b) % PRIME for a, b in pairs]


def _winners(hashes: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Rows that `select_winners` takes: segments begin at `starts`, rows of each in order of their positions."""
    n = len(hashes[0])
    used, at, of = np.zeros(n, bool), np.arange(n), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    for h in hashes:
        least = np.minimum.reduceat(np.where(used, np.iinfo(np.int64).max, h), starts)
        first = np.minimum.reduceat(np.where((h == least[of]) & ~used, at, n), starts)
        used[first[first < n]] = True
    return used


def lsp_counts(rows: DataFrame, dims: int, settings: Sequence[tuple[str, int, int, float | None]], seed: int = 0) -> list[int]:
    """Edges that `lsp` keeps for each (variant, k, hashed dimensions, step), in one pass; rows: `edge_features`."""
    settings = list(settings)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(t: pa.Table) -> pa.RecordBatch:
            u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(u), 2 * dims)
            starts = np.append(0, np.flatnonzero(u[1:] != u[:-1]) + 1)
            bits = np.stack([_winners(_hashes(x, dims, *s, seed), starts) for s in settings], axis=1)
            held = [b.tobytes() for b in np.packbits(bits, axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(held, pa.binary())], ["u", "v", "bits"])

        held: pa.Table | None = None  # a node's rows stay together
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            u = held.column("u").to_numpy()
            last = int(np.searchsorted(u, u[-1]))
            if last:
                yield chosen(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield chosen(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(settings), np.int64)
        for batch in batches:
            for c in (batch,) if batch.num_rows else ():
                a, b = (np.frombuffer(b"".join(c.column(k).to_pylist()), np.uint8).reshape(c.num_rows, -1) for k in ("a", "b"))
                n += np.unpackbits(a | b, axis=1)[:, : len(settings)].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["setting", "n"])

    cast = rows.select(F.col("u").cast("long"), F.col("v").cast("long"), "pos", "x")
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = cast.repartition(partitions, "u").sortWithinPartitions("u", "pos").select("u", "v", "x").mapInArrow(select, "u long, v long, bits binary")
    both = own.groupBy("u", "v").agg(F.min("bits").alias("a"), F.max("bits").alias("b"))  # an edge has two rows, one from either end
    found = both.select("a", "b").mapInArrow(count, "setting long, n long").groupBy("setting").agg(F.sum("n").alias("n"))
    of = {r["setting"]: r["n"] for r in found.collect()}
    return [of.get(k, 0) for k in range(len(settings))]
