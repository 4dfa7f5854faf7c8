"""Operator 3, best-fit packing: a grouping genetic algorithm on islands.

Documents become token ids and pieces of at most `capacity` ids. Pieces that
fill a sequence are sequences. The rest is dealt by a hash over islands of a
bounded number of pieces; each island, in a task of its own, breeds packings:
crossover injects whole well-filled bins of one parent into the other, drops
the bins that hold the same pieces, and best-fits what was displaced. Between
epochs each island sends its elite, its best-filled bins as lists of lengths,
to the next island, which rebuilds them from its own pieces and breeds on.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.tokens import by_bytes, tokenizer_path, word_memo
from lattica.session import discard, materialize, table

CAPACITY = 2048
END_ID = 0
#: Pieces on an island, on average.
ISLAND_PIECES = 4096
#: Packings that an island breeds, children in an epoch, and epochs (migrations in between).
POPULATION, CHILDREN, EPOCHS = 4, 10, 2
#: Bins that an island sends on; patterns of bins, whose number doesn't grow with the input.
ELITE_BINS = 256
#: Of a bin that counts as well-filled.
WELL_FILLED = 0.98
BATCH_BYTES = 8 << 20
SEED = 20_260
_NULL_ID = -(2**63)


class Packing:
    """Bins of one island: lists of piece numbers, and what each has left."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []

    def add_bin(self, pieces: list[int]) -> None:
        self.bins.append(pieces)
        self.left.append(self.capacity - sum(self.lengths[p] for p in pieces))

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece goes to the bin in which it leaves least; `rooms` has the bins by what they have left."""
        rooms: dict[int, list[int]] = {}
        mask = 0
        for b, r in enumerate(self.left):
            if r:
                rooms.setdefault(r, []).append(b)
                mask |= 1 << r
        lengths, bins, left = self.lengths, self.bins, self.left
        for p in pieces:
            size = lengths[p]
            fits = mask >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = rooms[r].pop()
                if not rooms[r]:
                    mask &= ~(1 << r)
                bins[b].append(p)
            else:
                r, b = self.capacity, len(bins)
                bins.append([p])
                left.append(0)
            r -= size
            left[b] = r
            if r:
                rooms.setdefault(r, []).append(b)
                mask |= 1 << r

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins of uneven fill, as emptier ones are easier to dissolve."""
        return -len(self.bins), float(sum((self.capacity - r) ** 2 for r in self.left))


def _descending(lengths: list[int], pieces: list[int]) -> list[int]:
    return sorted(pieces, key=lengths.__getitem__, reverse=True)


def crossover(a: Packing, b: Packing, rng: random.Random, well_filled: float = WELL_FILLED) -> Packing:
    """A child of a with whole well-filled bins of b; the pieces this displaces are best-fitted."""
    most = int(a.capacity * (1 - well_filled))
    good = [k for k, r in enumerate(b.left) if r <= most] or [min(range(len(b.left)), key=b.left.__getitem__)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    child = Packing(a.lengths, a.capacity)
    taken: set[int] = set()
    for k in chosen:
        child.add_bin(list(b.bins[k]))
        taken.update(b.bins[k])
    displaced: list[int] = []
    worst = sorted(range(len(a.left)), key=a.left.__getitem__, reverse=True)
    dissolved = set(worst[: max(1, len(worst) // 50)])  # mutation: the emptiest bins give up their pieces
    for k, pieces in enumerate(a.bins):
        if k in dissolved or not taken.isdisjoint(pieces):
            displaced.extend(p for p in pieces if p not in taken)
        else:
            child.bins.append(list(pieces))
            child.left.append(a.left[k])
    child.best_fit(_descending(a.lengths, displaced))
    return child


def rebuild(lengths: list[int], patterns: list[list[int]], capacity: int) -> Packing:
    """A packing that has migrated bins, rebuilt from own pieces of the same lengths."""
    free: dict[int, list[int]] = {}
    for p, size in enumerate(lengths):
        free.setdefault(size, []).append(p)
    out = Packing(lengths, capacity)
    for pattern in patterns:
        need: dict[int, int] = {}
        for size in pattern:
            need[size] = need.get(size, 0) + 1
        if all(len(free.get(size, ())) >= n for size, n in need.items()):
            out.add_bin([free[size].pop() for size in pattern])
    out.best_fit(_descending(lengths, [p for own in free.values() for p in own]))
    return out


def evolve(lengths: list[int], capacity: int, seed: int, start: list[list[int]] | None = None, patterns: list[list[int]] | None = None) -> Packing:
    """The best packing that an island breeds in an epoch, from its last best and its migrants."""
    rng = random.Random(seed)
    everything = list(range(len(lengths)))
    people: list[Packing] = []
    if start:
        people.append(Packing(lengths, capacity))
        for own in start:
            people[0].add_bin(own)
    if patterns:
        people.append(rebuild(lengths, patterns, capacity))
    if not start:
        people.append(Packing(lengths, capacity))
        people[-1].best_fit(_descending(lengths, everything))
    while len(people) < POPULATION:
        noisy = {p: lengths[p] * rng.uniform(0.8, 1.25) for p in everything}
        people.append(Packing(lengths, capacity))
        people[-1].best_fit(sorted(everything, key=noisy.__getitem__, reverse=True))
    floor = -(-sum(lengths) // capacity)
    scored = sorted(((p.fitness(), k, p) for k, p in enumerate(people)), reverse=True)
    for k in range(CHILDREN):
        if -scored[0][0][0] <= floor:
            break
        one, two = rng.sample(scored, 2)
        if two > one:
            one, two = two, one
        child = crossover(one[2], two[2], rng)
        scored = sorted([*scored[:-1], (child.fitness(), POPULATION + k, child)], reverse=True)
    return scored[0][2]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of docs (doc_id, text): ids, then the end id, cut only where they exceed capacity."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(tokenizer, spaces_dropped=False)
        end = struct.pack("<H", end_id)
        for batch in by_bytes(batches, BATCH_BYTES):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), memo.encode(batch.column("text").to_pylist())):
                wide = np.frombuffer(ids + end, "<u2").astype("<u4").tobytes()
                n = len(wide) // 4
                at, k = 0, 0
                while at < n:
                    to = min(n, at + ((n - at) % capacity or capacity))
                    rows.append((doc_id, k, at, to - at, zlib.crc32(wide[4 * at : 4 * to])))
                    at, k = to, k + 1
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, _PIECES)


def _island(pdf, capacity: int, seed: int, patterns: list[list[int]] | None):
    """One epoch of one island: its rows with their bin and offset."""
    pdf = pdf.sort_values("pid", ignore_index=True)
    lengths = pdf["length"].tolist()
    start = None
    if "bin" in pdf and len(pdf):
        order = np.argsort(pdf["bin"].to_numpy(), kind="stable")
        cuts = np.flatnonzero(np.diff(pdf["bin"].to_numpy()[order])) + 1
        start = [part.tolist() for part in np.split(order, cuts)]
    best = evolve(lengths, capacity, seed, start, patterns)
    bins = np.zeros(len(lengths), np.int32)
    offsets = np.zeros(len(lengths), np.int64)
    for b, own in enumerate(best.bins):
        at = 0
        for p in own:
            bins[p], offsets[p] = b, at
            at += lengths[p]
    pdf["bin"], pdf["offset"] = bins, offsets
    return pdf


def _breed(capacity: int, seed: int, names: list[str]):
    def breed(pdf, migrants):
        if not len(pdf):
            return pdf.reindex(columns=names)
        return _island(pdf, capacity, seed, [list(p) for p in migrants["pattern"]] if len(migrants) else None)[names]

    return breed


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    `pieces` has to be a stored table, as `cut_pieces` through `materialize` makes it.
    Every row gets a place, repeated ids and null ids too; an empty table gives none.
    """
    own = pieces.withColumn("pid", F.monotonically_increasing_id())
    whole = own.filter(F.col("length") >= capacity)
    # pandas has no null integers: a null id is the least one meanwhile
    part = own.filter(F.col("length") < capacity).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    n = part.count()
    islands = max(1, -(-n // island_pieces))
    fields = f"{_PIECES}, pid long, island int, bin int, offset long"
    names = [f.split()[0] for f in fields.split(", ")]
    dealt = part.withColumn("island", F.pmod(F.xxhash64(F.lit(seed), "pid"), F.lit(islands)).cast("int"))
    state = materialize(dealt.groupBy("island").applyInPandas(lambda pdf: _island(pdf, capacity, seed, None)[names], fields), "islands")
    for epoch in range(1, epochs if islands > 1 else 1):
        bins = state.groupBy("island", "bin").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list("length"), asc=False).alias("pattern"))
        best = W.partitionBy("island").orderBy(F.desc("fill"), F.size("pattern"), "bin")
        elite = (
            bins.filter(F.col("fill") >= WELL_FILLED * capacity)
            .withColumn("place", F.row_number().over(best))
            .filter(F.col("place") <= ELITE_BINS)  # the elite is what migrates; no piece is lost by it
            .select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "pattern")
        )
        breed = _breed(capacity, seed + epoch, names)
        last, state = state, materialize(state.groupBy("island").cogroup(elite.groupBy("island")).applyInPandas(breed, fields), "islands")
        discard(pieces.sparkSession, last)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    binned = state.withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL_ID))).select(*columns, (F.col("island").cast("long") * (1 << 32) + F.col("bin") * 2).alias("sequence_id"), "offset")
    alone = whole.select(*columns, (F.col("pid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return binned.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises docs (doc_id, text), cuts them into pieces and packs these.

    A null text is empty and makes one piece of the end id. Other columns are left behind.
    """
    return pack(materialize(cut_pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), capacity), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
