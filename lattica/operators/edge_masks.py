"""Edge deletion in closed form: the graphlets that hold an edge by shape, counted without listing them.

For an edge (u, v) its other neighbours fall into three classes: of u alone, of
v alone, of both. A 4-node set with the edge is two of them, joined or not, or
one and a node beyond that it is joined to. How many pairs of each kind there
are follows from degrees, triangles, 4-cliques and 4-cycles through the edge, so
hubs cost wedges, not wedges times degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import bidirectional, four_cliques
from lattica.operators.orbits import Parts, counting_parts, mask_table

#: Bits of a mask whose places are u, v, a, b.
UV, UA, UB, VA, VB, AB = 1, 2, 4, 8, 16, 32
_A = {"x": UA, "y": VA, "z": UA | VA}  # a as a neighbour of u alone, of v alone, of both
_B = {"x": UB, "y": VB, "z": UB | VB}


def mask_histogram(nodes: DataFrame, edges: DataFrame, parts: Parts | None = None) -> DataFrame:
    """u, v, size, mask and n: connected induced subgraphs that hold the edge, by shape around it."""
    edges, tri, sup, info = parts or counting_parts(nodes, edges)
    info = info.select("node", "d", "t", "r")
    two = bidirectional(edges)
    # by edge of a triangle: the third node's degree, and the supports of the two other edges
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.col(w).alias("w")) for p, q, w in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])
    third = tri.select(F.explode(sides).alias("k")).select("k.*").join(info.select(F.col("node").alias("w"), F.col("d").alias("dw")), "w")
    pair = lambda e: sup.select(F.col("u").alias("p"), F.col("v").alias("q"), F.col("support").alias(f"s_{e}"))
    for e in ("u", "v"):
        third = third.withColumns({"p": F.least(e, "w"), "q": F.greatest(e, "w")}).join(pair(e), ["p", "q"]).drop("p", "q")
    both = third.groupBy("u", "v").agg(F.sum("dw").alias("rz"), F.sum(F.col("s_u") - 1).alias("xz2"), F.sum(F.col("s_v") - 1).alias("yz2"))
    quads = four_cliques(edges, tri)
    six = [F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"))]
    clique = quads.select(F.explode(F.array(*six)).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("zz"))
    common = two.join(two.select("u", F.col("v").alias("w")), "u").filter("v < w").groupBy("v", "w").agg(F.count("*").alias("c")).filter("c > 1")
    around = two.join(two.select(F.col("u"), F.col("v").alias("w")), "u").filter("v <> w")  # v - u - w
    square = around.select("u", "v", "w", F.least("v", "w").alias("p"), F.greatest("v", "w").alias("q")).join(common.toDF("p", "q", "c"), ["p", "q"])
    # 4-cycles through (u, v): the other neighbours w of u, by what w and v have in common besides u
    cycles = square.filter("u < v").groupBy("u", "v").agg(F.sum(F.col("c") - 1).alias("cycles"))
    j = sup.join(info.toDF("u", "du", "tu", "ru"), "u").join(info.toDF("v", "dv", "tv", "rv"), "v")
    for part in (both, clique, cycles):
        j = j.join(part, ["u", "v"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    j = j.select("u", "v", F.col("support").alias("nz"), "du", "dv", "tu", "tv", "ru", "rv", *[zero(c) for c in ("rz", "xz2", "yz2", "zz", "cycles")])
    steps = {
        "nx": "du - 1 - nz", "ny": "dv - 1 - nz",
        # joined pairs of neighbours, by class
        "xz": "xz2 - 2 * zz", "yz": "yz2 - 2 * zz", "xx": "tu - nz - xz - zz", "yy": "tv - nz - yz - zz", "xy": "cycles - xz - yz - 2 * zz",
        # neighbours' degrees, and what of them leads beyond
        "rx": "ru - dv - rz", "ry": "rv - du - rz",
        "ox": "rx - nx - 2 * xx - xy - xz", "oy": "ry - ny - 2 * yy - xy - yz", "oz": "rz - 2 * nz - 2 * zz - xz - yz",
        "pxx": "nx * (nx - 1) div 2", "pyy": "ny * (ny - 1) div 2", "pzz": "nz * (nz - 1) div 2", "pxy": "nx * ny", "pxz": "nx * nz", "pyz": "ny * nz",
    }
    for name, how in steps.items():
        j = j.withColumn(name, F.expr(how))
    rows = [(2, UV, "1")] + [(3, UV | _A[i], f"n{i}") for i in "xyz"] + [(4, UV | AB | _A[i], f"o{i}") for i in "xyz"]
    for p in ("xx", "xy", "xz", "yy", "yz", "zz"):
        mask = UV | _A[p[0]] | _B[p[1]]
        rows += [(4, mask, f"p{p} - {p}"), (4, mask | AB, p)]
    shapes = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(m).alias("mask"), F.expr(n).cast("long").alias("n")) for s, m, n in rows])
    return j.select("u", "v", F.explode(shapes).alias("s")).select("u", "v", "s.*").filter("n > 0").groupBy("u", "v", "size", "mask").agg(F.sum("n").alias("n"))


def endpoint_delta(histogram: DataFrame) -> DataFrame:
    """u, v, node, orbit and delta at the two ends of each edge when it is deleted, from its shapes."""
    table = mask_table(histogram.sparkSession).filter("place < 2")
    before = histogram.join(F.broadcast(table), ["size", "mask"]).select("u", "v", "place", "orbit", (-F.col("n")).alias("n"))
    cut = histogram.withColumn("mask", F.col("mask") - UV)
    after = cut.join(F.broadcast(table), ["size", "mask"]).select("u", "v", "place", "orbit", "n")
    moved = before.unionByName(after).withColumn("node", F.when(F.col("place") == 0, F.col("u")).otherwise(F.col("v")))
    return moved.groupBy("u", "v", "node", "orbit").agg(F.sum("n").cast("long").alias("delta")).filter("delta <> 0")
