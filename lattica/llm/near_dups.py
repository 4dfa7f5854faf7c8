"""Operator 7, near-duplicates: min-max hashing with banding and exact confirmation.

A text's set has a 64-bit fingerprint for each distinct shingle of words. Texts
with equal sets are one class from the start, whatever their number. For each
permutation of the fingerprints a class keeps both the minimum and the maximum,
so PERMUTATIONS hash evaluations a shingle give twice as many signature values.

Classes that agree on a band of values share a bucket. Within a bucket the
classes whose signatures may belong to linked sets are joined to trees, not
pairs (`_bucket_trees`); their components over all buckets are groups that hold
every link. Groups are confirmed on full sets, again as trees.

A bucket or group beyond a bound is cut into blocks. First each block is joined
with a few pivots; members that one tree holds by then are done with each other,
and only blocks that hold different trees meet (`_linked`). A million copies of
one page that differ a little are thus compared with the pivots and with the few
that no pivot reaches, and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.tokens import by_bytes
from lattica.operators.components import connected_components
from lattica.session import discard, materialize, table

#: Permutations; each gives a minimum and a maximum.
PERMUTATIONS = 72
#: Two sets just at the threshold share no band in fewer cases than this: 1 of 86,000 at 0.85 (24 bands of 6
#: values), 1 of 66,000 at 0.8 (28 bands of 5), and far fewer above.
MISSED = 2e-5
#: Signatures that agree on fewer values than the threshold less this many standard deviations aren't candidates.
DEVIATIONS = 4.5
#: Classes in a block of a bucket (signatures: 1.2 MB), and of a group that is confirmed on full sets (texts).
BUCKET_BLOCK, GROUP_BLOCK = 8192, 512
#: Classes near others up to which their table is broadcast (a row is 40 bytes).
BROADCAST_CLASSES = 500_000
#: Pivots of a bucket or group that is cut into blocks.
PIVOTS = 8
BATCH_BYTES = 2 << 20
SEED = 20_260
VALUES = 2 * PERMUTATIONS


class Shingler:
    """Fingerprint sets of texts, and their signatures."""

    MEMO = 150_000

    def __init__(self, words: int, permutations: int = PERMUTATIONS, seed: int = SEED):
        import xxhash

        self.words, self.hash = words, xxhash.xxh64_intdigest
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 63, (permutations, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (permutations, 1), np.uint64)
        self.m = rng.integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)
        self.memo: dict[bytes, int] = {}

    def fingerprints(self, text: str | None) -> np.ndarray:
        """Sorted distinct fingerprints: of runs of words, or of the whole sequence where it's shorter; A-Z count as a-z."""
        found = (text or "").encode().lower().split()
        memo = self.memo
        if len(memo) > self.MEMO:
            memo.clear()
        try:
            codes = [memo[w] for w in found]
        except KeyError:
            for w in found:
                if w not in memo:
                    memo[w] = self.hash(w)
            codes = [memo[w] for w in found]
        w = np.array(codes, np.uint64)
        n = min(len(w), self.words)
        if not n:
            return w
        out = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ w[k : len(w) - n + 1 + k]) * self.m[k]
            out ^= out >> np.uint64(29)
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        return np.unique(out ^ out >> np.uint64(32))

    def signature(self, prints: np.ndarray) -> np.ndarray:
        """Minimum and maximum under each permutation."""
        out = np.empty((len(self.a), 2), np.uint64)
        for at in range(0, len(prints), 1 << 15):  # long texts in parts
            h = prints[at : at + (1 << 15)] * self.a + self.b
            low, high = h.min(axis=1), h.max(axis=1)
            out[:, 0] = low if not at else np.minimum(out[:, 0], low)
            out[:, 1] = high if not at else np.maximum(out[:, 1], high)
        return out.reshape(-1)


@lru_cache(maxsize=2)
def _shingler(words: int) -> Shingler:
    """A worker's own, so that small groups share its memory of words."""
    return Shingler(words)


def band_rows(threshold: float) -> int:
    """Values in a band: as many as MISSED allows, so that buckets are small."""
    return max(r for r in range(1, VALUES + 1) if r == 1 or (1 - threshold**r) ** (VALUES // r) <= MISSED)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; values that fill no band are left over."""
    s = signature[: len(signature) // rows * rows].reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64)
    for k in range(rows):
        key = (key ^ s[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def least_agreement(threshold: float) -> int:
    """Signature values on which linked sets agree, but for a share far below the banding's own."""
    return max(1, int(VALUES * threshold - DEVIATIONS * (VALUES * threshold * (1 - threshold)) ** 0.5))


class Trees:
    """Union-find over the members of a task."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, k: int) -> int:
        while self.of[k] != k:
            self.of[k] = self.of[self.of[k]]
            k = self.of[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)


def _trees(signatures: np.ndarray, least: int, linked: Callable[[int, int], bool] | None, side: np.ndarray | None) -> Trees:
    """Joins members whose signatures agree enough and for which `linked` holds, asking only for pairs of different trees.

    With `side`, pairs within a side are left to other tasks.
    """
    n = len(signatures)
    trees = Trees(n)
    label = np.arange(n)
    for k in range(n - 1):
        rest = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        if side is not None:
            rest = rest[side[rest] != side[k]]
        if not len(rest):
            continue
        agree = (signatures[rest] == signatures[k]).sum(axis=1)
        for j in rest[agree >= least][np.argsort(-agree[agree >= least], kind="stable")].tolist():
            if label[j] != label[k] and (linked is None or linked(k, j)):
                trees.join(k, j)
                low, high = sorted((label[k], label[j]))
                label[label == high] = low
    return trees


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for at, to in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = keys[at]
    if held:
        yield pa.Table.from_batches(held)


def _sides(t: pa.Table) -> np.ndarray | None:
    side = t.column("side").to_numpy()
    return None if (side == 0).all() else side


def _bytes_column(t: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, width)


def sketch(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and a byte of each signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = _shingler(words)
        for batch in by_bytes(batches, BATCH_BYTES):
            n, digest, keys, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                prints = shingler.fingerprints(text)
                n.append(len(prints))
                if len(prints):
                    s = shingler.signature(prints)
                    digest.append(xxhash.xxh128_digest(prints.tobytes()))
                    keys.append(bands(s, rows).view(np.int64))
                    sig.append((s ^ s >> np.uint64(23)).astype(np.uint8).tobytes())
                else:
                    digest.append(None)
                    keys.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


def _forest(tasks: DataFrame, make: Callable[[pa.Table], tuple[np.ndarray, Trees] | None], partitions: int) -> DataFrame:
    """Edges (u, v) of the trees that `make` finds in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for t in _grouped(batches, "task"):
            if t.num_rows > 1:
                reps, trees = make(t)
                for k in range(len(reps)):
                    if (r := trees.root(k)) != k:
                        u.append(int(reps[k]))
                        v.append(int(reps[r]))
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return tasks.repartition(partitions, "task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def _sizes(members: DataFrame, key: str) -> DataFrame:
    """key and size of the keys with more than one member."""
    return materialize(members.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1"), "sizes")


def _linked(members: DataFrame, sizes: DataFrame, key: str, block: int, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v) of trees that hold every link between members (cls, weight) of equal `key`, whose `sizes` are known.

    `link` finds the trees of tasks (cls, task, side): pairs of different sides
    are compared, or all pairs of a task whose side is 0. A key of up to `block`
    members is a task. A larger one is cut into blocks, in two rounds: each block
    with the key's PIVOTS (those of most weight in as many hash classes), then
    blocks that hold different trees with each other. A tree of more than a block
    has blocks of its own, which don't meet; the rest share blocks that meet all.
    Tasks are stored before they meet what members hold: as their size is known
    then, few tasks don't make that table shuffle.
    """
    small = members.join(sizes.filter(F.col("size") <= block), key).select("cls", F.xxhash64(key).alias("task"), F.lit(0).alias("side"))
    large = sizes.filter(F.col("size") > block)
    if large.isEmpty():
        return link(materialize(small, "tasks"))
    draw = F.xxhash64(F.lit(SEED), "cls")
    n_blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = materialize(members.join(large, key), "members")
    best = held.groupBy(key, F.pmod(draw, F.lit(PIVOTS)).alias("of")).agg(F.max(F.struct("weight", draw.alias("draw"), "cls")).alias("best"))
    pivots = best.join(large, key).select(key, every(n_blocks("size")).alias("own"), F.col("best.cls").alias("cls"), F.lit(2).alias("side"))
    dealt = held.select(key, F.pmod(draw, n_blocks("size")).cast("int").alias("own"), "cls", F.lit(1).alias("side"))
    near = dealt.unionByName(pivots).select("cls", F.xxhash64(F.lit("p"), key, "own").alias("task"), "side")
    first = materialize(link(materialize(near, "tasks")), "first")
    trees = connected_components(first).select(F.col("node").alias("cls"), F.col("component").alias("tree"))
    known = materialize(held.join(trees, "cls", "left").select(key, "cls", F.coalesce("tree", "cls").alias("tree")), "known")
    of_tree = known.groupBy(key, "tree").agg(F.count("*").alias("n"))
    # units of a key: each tree of more than a block, and (null) what is left
    unit = F.when(F.col("n") > block, F.col("tree"))
    units = materialize(of_tree.groupBy(key, unit.alias("unit")).agg(F.sum("n").alias("n"), F.count("*").alias("trees")), "units")
    units = units.select(key, "unit", n_blocks("n").alias("blocks"), F.when(F.col("unit").isNull(), F.col("trees")).alias("trees"))
    other = units.select(key, F.col("unit").alias("unit2"), F.col("blocks").alias("blocks2"))
    same = F.col("unit").eqNullSafe(F.col("unit2"))
    meet = units.join(other, key).filter(~same | (F.col("trees") > 1)).drop("trees")
    wide = of_tree.filter(F.col("n") > block).select(key, "tree", F.col("tree").alias("of"))
    placed = known.join(wide, [key, "tree"], "left").select(key, "cls", F.col("of").alias("of"))
    here = (placed[key] == meet[key]) & F.col("of").eqNullSafe(F.col("unit"))
    met = placed.join(meet, here).select(placed[key], "cls", "unit", "unit2", F.pmod(draw, F.col("blocks")).cast("int").alias("own"), every(F.col("blocks2")).alias("own2"))
    # a unit meets another as the lesser or the greater side; null is the least
    one, two = F.struct("unit", "own"), F.struct(F.col("unit2").alias("unit"), F.col("own2").alias("own"))
    low, high = F.when(one <= two, one).otherwise(two), F.when(one <= two, two).otherwise(one)
    side = F.when(one == two, 0).when(one < two, 1).otherwise(2)
    second = met.select("cls", F.xxhash64(F.lit("m"), key, low["unit"].isNull(), low["unit"], low["own"], high["unit"].isNull(), high["unit"], high["own"]).alias("task"), side.alias("side"))
    return link(materialize(small, "tasks")).unionByName(first).unionByName(link(materialize(second, "tasks")))


def near_duplicates(docs: DataFrame, words: int = 3, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Rows are linked where the similarity of their sets is at least
    threshold[0] / threshold[1]; component_id is the least doc_id reachable.
    Texts without words (null too) have an empty set and are linked with
    nothing. Rows that repeat a doc_id are one document: they share all links
    of any of them. A null doc_id is linked with nothing: component_id null,
    kept. An empty table gives none; other columns are left behind.
    """
    spark = docs.sparkSession
    above, below = threshold
    least = least_agreement(above / below)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = band_rows(above / below)
    drawn = materialize(sketch(docs, words, rows), "sketch")
    held = drawn.filter("digest is not null and doc_id is not null")
    # classes of equal sets: the group-by combines copies before it shuffles. Their numbers hold once they are stored
    grouped = held.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    keys = materialize(classes.select("cls", F.explode("bands").alias("band")), "bands")

    def by_signature(tasks: DataFrame) -> DataFrame:
        def trees(t: pa.Table) -> tuple[np.ndarray, Trees]:
            return t.column("cls").to_numpy(), _trees(_bytes_column(t, VALUES), least, None, _sides(t))

        return _forest(tasks.join(classes.select("cls", "sig"), "cls"), trees, partitions)

    buckets = _sizes(keys, "band")
    groups = connected_components(_linked(keys.withColumn("weight", F.lit(0)), buckets, "band", BUCKET_BLOCK, by_signature))
    groups = groups.select(F.col("node").alias("cls"), "component")
    # documents of several rows: a text for each of their sets, found by the set
    ids = held.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = materialize(ids, "repeated")
    near = materialize(classes.select("cls", "rep", "digest").join(groups.select("cls"), "cls", "left_semi"), "near")
    several = not repeated.isEmpty()
    wanted = F.broadcast(near) if near.count() <= BROADCAST_CLASSES else near
    singles = docs.join(repeated, "doc_id", "left_anti") if several else docs
    texts = singles.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep").select("cls", "text")
    if several:
        own = materialize(_by_set(docs.join(repeated, "doc_id", "left_semi"), words).groupBy("doc_id", "digest").agg(F.first("text").alias("text")), "several")
        texts = texts.unionByName(near.join(own.withColumnRenamed("doc_id", "rep"), ["rep", "digest"]).select("cls", "text"))
    # read by up to three rounds: only texts of classes that are near others
    texts = materialize(texts, "texts")

    def by_sets(tasks: DataFrame) -> DataFrame:
        def trees(t: pa.Table) -> tuple[np.ndarray, Trees]:
            shingler = _shingler(words)
            sets = [shingler.fingerprints(x) for x in t.column("text").to_pylist()]
            byte = np.array([(s ^ s >> np.uint64(23)).astype(np.uint8) for s in map(shingler.signature, sets)]).reshape(-1, VALUES)

            def linked(a: int, b: int) -> bool:
                small, large = sorted((len(sets[a]), len(sets[b])))
                if below * small < above * large:
                    return False
                both = np.concatenate([sets[a], sets[b]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                return below * common >= above * (len(both) - common)

            return t.column("cls").to_numpy(), _trees(byte, least, linked, _sides(t))

        return _forest(tasks.join(texts, "cls"), trees, partitions)

    # what many buckets hold is near many others: the text that copies were made from rather than a copy
    shared = materialize(buckets.filter(F.col("size") > GROUP_BLOCK), "shared")
    weights = keys.join(shared, "band").groupBy("cls").agg(F.sum("size").alias("weight"))
    members = groups.join(weights, "cls", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    edges = _linked(members, _sizes(groups, "component"), "component", GROUP_BLOCK, by_sets)
    if several:
        in_class = own.join(classes.select("digest", "cls"), "digest").select("doc_id", "cls")
        led = in_class.groupBy("doc_id").agg(F.min("cls").alias("u"))
        edges = edges.unionByName(in_class.join(led, "doc_id").select("u", F.col("cls").alias("v")))
    links = connected_components(edges)
    reached = links.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    lowest = reached.groupBy("component").agg(F.min("rep").alias("least"))
    least_of = links.join(lowest, "component").select(F.col("node").alias("cls"), "least")
    of_class = classes.select("digest", "cls", "rep").join(least_of, "cls", "left").select("digest", F.coalesce("least", "rep").alias("least"))
    out = drawn.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    if several:  # rows without words too have what their document has
        of_id = own.join(of_class, "digest").groupBy("doc_id").agg(F.min("least").alias("shared"))
        out = out.join(of_id, "doc_id", "left").withColumn("least", F.coalesce("shared", "least"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _by_set(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest of the set and text of the rows with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = _shingler(words)
        for batch in by_bytes(batches, BATCH_BYTES):
            sets = [shingler.fingerprints(t) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.binary()), batch.column("text").cast(pa.string())], ["doc_id", "digest", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, text string").filter("digest is not null")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on sets of 3-word shingles at similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Brute force over all pairs of documents that share a shingle.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON s.doc_id = c.a
"""
