"""Operator 8, approximate nearest neighbours: multi-index hashing.

Vectors become binary codes by a learned rotation (iterative quantisation on a
bounded sample). A code is split into substrings and each substring is an index
from its value to the rows that have it. Codes within radius r of a query agree
with it in some substring up to r // substrings bits (pigeonhole), so probing
these balls retrieves every code within r; their rows are ranked by the inner
product of the original vectors in double precision.

Rows are dealt over blocks by a hash, each row once, and a block is one task that
holds its index. Queries pass every block in batches, so memory is bounded by a
block of rows, whatever the number of queries. A task keeps the best k of each
query, so what is shuffled for a query is itself and k rows for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.session import table

#: Rows in a block of the index, on average.
ROW_BLOCK = 16_384
#: Rows that the rotation and the radius are learned from, at most: those with the least hash of their id.
SAMPLE_ROWS = 4_096
#: Passes of iterative quantisation.
ROTATIONS = 30
#: Bits of a substring.
SUBSTRING = 16
#: Share of the sample's true neighbours that the radius has to reach. The sample is sparser than the
#: table, so its neighbours are farther and the radius reaches more of the table's.
REACH = 0.97
SEED = 20_260

_POP = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)


def clean(rows: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles of the rows that take part: no nulls, not all zero, every component finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    ok = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad & some)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Substrings of the codes, a row each, as 16-bit numbers."""
    bits = ((x - mean) @ rotation > 0).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, rotation and radius from a sample: rotated so that the signs lose least, wide enough for its own neighbours."""
    dims = sample.shape[1]
    width = -(-dims // SUBSTRING) * SUBSTRING
    mean = sample.mean(axis=0) if len(sample) > 1 else np.zeros(dims)
    x = np.zeros((len(sample), width))
    x[:, :dims] = sample - mean
    rng = np.random.Generator(np.random.PCG64(seed))
    r = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(ROTATIONS):
        signs = np.where(x @ r > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ x)
        r = (u @ v).T
    rotation = r[:dims]
    if len(sample) < 2:
        return mean, rotation, width
    codes = _codes(sample, mean, rotation)
    queries = np.arange(0, len(sample), max(1, len(sample) // 256))
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    distances = _POP[codes[queries][:, None, :] ^ codes[near]].sum(axis=2, dtype=np.int64)
    return mean, rotation, int(np.ceil(np.quantile(distances, REACH)))


class MultiIndex:
    """The index of a block: for each substring its values in order, and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, first = np.unique(codes[order, s], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))
        self.balls: dict[int, np.ndarray] = {}

    def _ball(self, t: int) -> np.ndarray:
        if t not in self.balls:
            self.balls[t] = np.flatnonzero(_POP <= t).astype(np.uint16)
        return self.balls[t]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius, by probing the balls around the query's substrings."""
        t = min(SUBSTRING, radius // len(self.tables))
        ball = self._ball(t)
        hit = np.zeros(self.n, bool)
        for (values, first, order), own in zip(self.tables, code):
            if len(ball) < len(values):  # look each of the ball's values up
                probes = ball ^ own
                at = np.searchsorted(values, probes)
                at[at == len(values)] = 0
                at = at[values[at] == probes]
            else:  # the ball has more values than the table
                at = np.flatnonzero(_POP[values ^ own] <= t)
            if len(at) == len(values):
                hit[:] = True
                break
            starts, lengths = first[at], first[at + 1] - first[at]
            if len(at):
                ends = np.cumsum(lengths)
                hit[order[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]] = True
        rows = np.flatnonzero(hit)
        return rows[_POP[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def search(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that `is_query` holds for its k nearest others.

    `rows` has vec_id and embedding. Rows that `clean` drops take no part, nor do
    those whose number of components isn't the most frequent one (of equally
    frequent ones the largest). Nearness is the inner product, ties go to the lesser
    vec_id; rows that share the query's vec_id are its own. A vec_id that occurs
    twice is two rows. Fewer than k others give as many; an empty table gives none.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    ok = clean(rows)
    sizes = ok.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    dims = most[0]["dims"]
    ok = ok.filter(F.size("embedding") == dims)
    count = most[0]["n"]
    sampled = ok.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    mean, rotation, radius = learn(np.array([r["embedding"] for r in sampled]), k)
    asked = ok.filter(is_query)
    row_blocks = max(1, -(-count // ROW_BLOCK))
    own = F.pmod(F.xxhash64(F.lit(SEED), "vec_id", F.col("embedding")[0]), F.lit(row_blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    indexed = ok.select(own.alias("task"), F.lit(0).alias("asks"), "vec_id", "embedding")
    asking = asked.select(every.alias("task"), F.lit(1).alias("asks"), "vec_id", "embedding")
    tasks = indexed.unionByName(asking)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        task, index, keep, given = -1, None, None, None
        for batch in batches:  # sorted: a task's rows, then its queries
            if not batch.num_rows:
                continue
            of, asks = batch.column("task").to_numpy(), batch.column("asks").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            x = batch.column("embedding").flatten().to_numpy().reshape(-1, dims)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for at, to in zip([0, *cuts], [*cuts, len(of)]):
                if of[at] != task:
                    task, index, held = of[at], None, []
                if not asks[at]:
                    held.append((ids[at:to].copy(), x[at:to].copy()))
                    continue
                if not held:
                    continue
                if index is None:
                    keep, given = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    index = MultiIndex(_codes(given, mean, rotation))
                yield from nearest(index, keep, given, ids[at:to], x[at:to])

    def nearest(index: MultiIndex, keep: np.ndarray, given: np.ndarray, asking_ids: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for qid, q, code in zip(asking_ids, wanted, _codes(wanted, mean, rotation)):
            r = radius
            while True:
                found = index.within(code, r)
                found = found[keep[found] != qid]
                if len(found) >= k or r >= code.size * SUBSTRING:
                    break
                r = min(2 * r + 1, code.size * SUBSTRING)
            score = (given[found] * q).sum(axis=1)
            if len(found) > k:  # all that may be among the k, ties with the last included
                cut = np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[score >= cut], score[score >= cut]
            order = np.lexsort((keep[found], -score))[:k]
            out.append((np.full(len(order), qid), keep[found][order], score[order]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["query_id", "vec_id", "score"])

    found = tasks.repartitionById(row_blocks, "task").sortWithinPartitions("task", "asks").mapInArrow(best, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each embedding whose vec_id is divisible by 20, against all."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
