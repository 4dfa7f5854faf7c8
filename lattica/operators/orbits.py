"""Graphlet orbits 0 to 14: counts of each node's roles in connected induced subgraphs of 2 to 4 nodes."""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.graph import bidirectional, degrees, four_cliques, support, triangles
from lattica.session import stored

ORBITS = 15
#: Bits of a mask: pairs of places in a graphlet's sorted nodes.
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: Analysis groups of orbits.
GROUPS = {"low_order": [0, 1, 2, 3], "path4": [4, 5], "star4": [6, 7], "cycle4": [8], "tailed_triangle": [9, 10, 11], "dense4": [12, 13, 14]}


def _role(size: int, edges: int, top: int, own: int) -> int:
    """The orbit of a node of degree `own` in a connected graphlet with so many edges and greatest degree `top`."""
    if size == 2:
        return 0
    if size == 3:
        return 3 if edges == 3 else own
    if edges == 3:
        return (3 if top == 2 else 5 if own == 1 else 4) + own
    if edges == 4:
        return 8 if top == 2 else 8 + own
    return 10 + own if edges == 5 else 14


def masks() -> list[tuple[int, int, int, int]]:
    """(size, mask, place, orbit) for every place of every connected graph on 2 to 4 places, by rule."""
    out = []
    for size in (2, 3, 4):
        bits = [k for k, (a, b) in enumerate(PAIRS) if b < size]
        for n in range(size - 1, len(bits) + 1):
            for chosen in combinations(bits, n):
                reach, grew = {0}, True
                while grew:
                    grew = False
                    for k in chosen:
                        if (PAIRS[k][0] in reach) != (PAIRS[k][1] in reach):
                            reach |= set(PAIRS[k])
                            grew = True
                if len(reach) == size:
                    deg = [sum(p in PAIRS[k] for k in chosen) for p in range(size)]
                    out += [(size, sum(1 << k for k in chosen), p, _role(size, n, max(deg), deg[p])) for p in range(size)]
    return out


def registry() -> list[tuple[int, int, int, int, int]]:
    """(orbit, size, edges, multiplicity, role degree) of each orbit, from the masks."""
    out = {}
    for size, mask, place, orbit in masks():
        chosen = [PAIRS[k] for k in range(6) if mask >> k & 1]
        own = sum(place in p for p in chosen)
        same = sum(1 for s, m, _, o in masks() if (s, m) == (size, mask) and o == orbit)
        out[orbit] = (orbit, size, len(chosen), same, own)
    return [out[k] for k in sorted(out)]


def mask_table(spark: SparkSession) -> DataFrame:
    """size, mask, place, orbit: a fixed table of a few hundred rows."""
    return spark.createDataFrame(masks(), "size int, mask int, place int, orbit int")


def graphlets(edges: DataFrame) -> DataFrame:
    """size, n (sorted nodes) and mask of every connected induced subgraph of 2 to 4 nodes.

    Enumerates: the number of rows grows with wedges times degree, so hubs cost
    much. `gdv_closed` counts without it.
    """
    two = bidirectional(edges.select("u", "v"))
    pairs = edges.select(F.array("u", "v").alias("n"), F.lit(1).alias("mask"))
    wedge = two.join(two.select("u", F.col("v").alias("w")), "u").filter("v < w")
    triples = wedge.select(F.array_sort(F.array("u", "v", "w")).alias("n")).distinct()
    grown = triples.withColumn("u", F.explode("n")).join(two, "u").filter(~F.array_contains("n", F.col("v")))
    quads = grown.select(F.array_sort(F.concat("n", F.array("v"))).alias("n")).distinct()
    slots = [F.struct(F.lit(1 << k).alias("bit"), F.col("n")[a].alias("u"), F.col("n")[b].alias("v")) for k, (a, b) in enumerate(PAIRS)]

    def masked(sets: DataFrame, size: int) -> DataFrame:
        own = [s for s, (_, b) in zip(slots, PAIRS) if b < size]
        j = sets.select("n", F.explode(F.array(*own)).alias("s")).select("n", "s.*").join(edges.select("u", "v"), ["u", "v"])
        return j.groupBy("n").agg(F.sum("bit").cast("int").alias("mask"))

    parts = [(pairs, 2), (masked(triples, 3), 3), (masked(quads, 4), 4)]
    out = [p.select(F.lit(size).alias("size"), "n", "mask") for p, size in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def gdv_long(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """node, orbit and cnt (0 where a node has none) from graphlets."""
    spark = nodes.sparkSession
    j = found.join(F.broadcast(mask_table(spark)), ["size", "mask"])
    n = j.select(F.expr("n[place]").alias("node"), "orbit").groupBy("node", "orbit").agg(F.count("*").alias("cnt"))
    every = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(ORBITS - 1))).alias("orbit"))
    return every.join(n, ["node", "orbit"], "left").select("node", "orbit", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def wide(long: DataFrame) -> DataFrame:
    """node and o0 to o14."""
    return long.groupBy("node").agg(*[F.sum(F.when(F.col("orbit") == k, F.col("cnt")).otherwise(0)).cast("long").alias(f"o{k}") for k in range(ORBITS)])


class Parts(NamedTuple):
    """What counting reads again and again: edges, triangles, supports, and of each node its degree d, triangles t, and its neighbours' degrees r, without the edge to it p."""

    edges: DataFrame
    triangles: DataFrame
    support: DataFrame
    info: DataFrame


def counting_parts(nodes: DataFrame, edges: DataFrame) -> Parts:
    """A graph's parts, stored: each is read by several branches of the counts, and would be planned and computed for each of them."""
    edges = stored(edges.select("u", "v"), "edges")
    tri = stored(triangles(edges), "triangles")
    sup = stored(support(edges, tri), "support")
    deg = stored(degrees(nodes, edges), "degrees")
    corner = tri.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    near = bidirectional(edges).join(deg.toDF("v", "degree"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("degree").alias("r"), F.sum(F.col("degree") - 1).alias("p"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    info = deg.join(corner, "node", "left").join(near, "node", "left").select("node", F.col("degree").alias("d"), z("t"), z("r"), z("p"))
    return Parts(edges, tri, sup, stored(info, "info"))


def gdv_closed(nodes: DataFrame, edges: DataFrame, parts: Parts | None = None) -> DataFrame:
    """node and o0 to o14 by identities over degrees, triangles, common neighbours and 4-cliques: no enumeration of 4-node sets."""
    edges, tri, sup, info = parts or counting_parts(nodes, edges)
    two = bidirectional(sup)
    of = lambda name, **columns: info.select(F.col("node").alias(name), *[F.col(c).alias(a) for a, c in columns.items()])
    c2 = lambda c: c * (c - 1) / 2
    around = (
        two.join(of("v", dv="d", tv="t", p="p"), "v")
        .join(of("u", du="d"), "u")
        .groupBy(F.col("u").alias("node"))
        .agg(
            F.sum(F.col("dv") - 1).alias("s1"),
            F.sum(c2(F.col("support"))).alias("s13"),
            F.sum(F.col("tv") - F.col("support")).alias("s9"),
            F.sum(c2(F.col("dv") - 1)).alias("s6"),
            F.sum((F.col("du") - 1) * (F.col("dv") - 1) - F.col("support")).alias("s5"),
            F.sum(F.col("p") - (F.col("du") - 1)).alias("s4"),
        )
    )
    corners = F.array(*[F.struct(F.col(x).alias("node"), F.least(y, z).alias("u"), F.greatest(y, z).alias("v")) for x, y, z in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))])
    opposite = tri.select(F.explode(corners).alias("k")).select("k.*").join(sup, ["u", "v"])
    opposite = opposite.join(of("u", du="d"), "u").join(of("v", dv="d"), "v")
    by_tri = opposite.groupBy("node").agg(F.sum(F.col("support") - 1).alias("s12"), F.sum(F.col("du") + F.col("dv") - 4).alias("s10"))
    plain = bidirectional(edges)
    common = plain.join(plain.select("u", F.col("v").alias("w")), "u").filter("v < w").groupBy("v", "w").agg(F.count("*").alias("c")).filter("c > 1")
    squares = common.select(F.explode(F.array("v", "w")).alias("node"), "c").groupBy("node").agg(F.sum(c2(F.col("c"))).alias("s8"))
    cliques = four_cliques(edges, tri).select(F.explode(F.array("a", "b", "c", "d")).alias("node")).groupBy("node").agg(F.count("*").alias("k4"))
    j = info.select("node", "d", "t")
    for part in (around, by_tri, squares, cliques):
        j = j.join(part, "node", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    j = j.select("node", "d", "t", *[z(c).alias(c) for c in ("s1", "s13", "s9", "s6", "s5", "s4", "s12", "s10", "s8", "k4")])
    steps = {
        "o0": "d", "o3": "t", "o1": "s1 - 2 * o3", "o2": "d * (d - 1) div 2 - o3", "o14": "k4", "o13": "s13 - 3 * o14", "o12": "s12 - 3 * o14",
        "o11": "t * (d - 2) - 2 * o13 - 3 * o14", "o10": "s10 - 2 * o12 - 2 * o13 - 6 * o14", "o9": "s9 - 2 * o12 - 3 * o14", "o8": "s8 - o12 - o13 - 3 * o14",
        "o7": "d * (d - 1) * (d - 2) div 6 - o11 - o13 - o14", "o6": "s6 - o9 - o10 - 2 * o12 - o13 - 3 * o14",
        "o5": "s5 - 2 * o8 - o10 - 2 * o11 - 2 * o12 - 4 * o13 - 6 * o14", "o4": "s4 - 2 * t - 2 * o8 - 2 * o9 - o10 - 4 * o12 - 2 * o13 - 6 * o14",
    }
    for name, how in steps.items():
        j = j.withColumn(name, F.expr(f"cast({how} as long)"))
    return j.select("node", *[f"o{k}" for k in range(ORBITS)])


def to_long(counts: DataFrame) -> DataFrame:
    """node, orbit, cnt from o0 to o14."""
    return counts.select("node", F.posexplode(F.array(*[f"o{k}" for k in range(ORBITS)])).alias("orbit", "cnt"))


def standardization(long: DataFrame) -> DataFrame:
    """orbit, mu and sd of log1p counts over nodes (population; sd below 1e-12 is 1): 15 rows."""
    x = F.log1p(F.greatest(F.col("cnt"), F.lit(0)).cast("double"))
    s = long.groupBy("orbit").agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"))
    return s.select("orbit", "mu", F.when(F.col("sd") < 1e-12, 1.0).otherwise(F.col("sd")).alias("sd"))


def standardized(long: DataFrame, stats: DataFrame) -> DataFrame:
    """node, orbit, cnt and z under the given statistics."""
    z = (F.log1p(F.greatest(F.col("cnt"), F.lit(0)).cast("double")) - F.col("mu")) / F.col("sd")
    return long.join(F.broadcast(stats), "orbit").select("node", "orbit", "cnt", z.alias("z"))
