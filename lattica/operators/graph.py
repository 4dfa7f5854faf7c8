"""Graph algebra on edges(u, v), u < v, and nodes(node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def canonical_edges(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """Distinct undirected edges without loops, u < v; with `nodes`, an id outside 0 .. nodes - 1 is an error."""
    out = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if nodes is None:
        return out
    ok = (F.col("u") >= 0) & (F.col("v") < nodes)
    return out.withColumn("u", F.when(ok, F.col("u")).otherwise(F.raise_error(F.lit("node id out of range")).cast("long")))


def bidirectional(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with any other columns."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def replace_edges(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph with other edges: the same nodes with all their columns (labels, features, splits), and the new edges' u, v and weight, if named.

    The new edges are taken as they come and needn't be among the old ones.
    """
    return nodes, edges.select("u", "v", *([F.col(weight).cast("double").alias("weight")] if weight else []))


def edge_ids(edges: DataFrame) -> DataFrame:
    """edge_id from 0 in the order of (u, v). One global order: meant for graphs that a sequential method follows."""
    return edges.withColumn("edge_id", F.row_number().over(W.orderBy("u", "v")).cast("long") - 1)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and degree; 0 for isolated nodes."""
    d = bidirectional(edges.select("u", "v")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node and its sorted neighbours."""
    return bidirectional(edges.select("u", "v")).groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


def csr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, row_ptr, degree and col_idx: compressed rows as a table, ordered by node."""
    rows = degrees(nodes, edges).join(adjacency(edges), "node", "left")
    before = W.orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("degree").over(before), F.lit(0))
    return rows.select("node", start.alias("row_ptr"), "degree", F.coalesce("neighbours", F.array().cast("array<long>")).alias("col_idx"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once as a, b, c.

    Edges point from the lower to the higher (degree, id): no node has more
    than sqrt(2 E) successors, so hubs don't make quadratically many wedges.
    """
    two = bidirectional(edges.select("u", "v"))
    d = two.groupBy("u").agg(F.count("*").alias("d"))
    e = edges.select("u", "v").join(d, "u").withColumnRenamed("d", "du").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    o = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").filter("b < c")
    return wedge.join(edges.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"]).select("a", "b", "c")


def four_cliques(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Each 4-clique once: a < b < c < d; `found` are the triangles."""
    s = F.array_sort(F.array("a", "b", "c"))
    t = found.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))
    q = t.join(t.select("a", "b", F.col("c").alias("d")), ["a", "b"]).filter("c < d")
    return q.join(edges.select(F.col("u").alias("c"), F.col("v").alias("d")), ["c", "d"]).select("a", "b", "c", "d")


def support(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """u, v and support: common neighbours of an edge's ends."""
    found = triangles(edges) if found is None else found
    pairs = F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
    n = found.select(F.explode(pairs).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("support"))
    return edges.select("u", "v").join(n, ["u", "v"], "left").select("u", "v", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within `hops` of the seeds (node), seeds included."""
    two = bidirectional(edges.select("u", "v"))
    out = seeds.select("node").distinct()
    for _ in range(hops):
        out = out.union(out.join(two, out["node"] == two["u"]).select(F.col("v").alias("node"))).distinct()
    return out


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.select("node").join(bidirectional(edges.select("u", "v")).select(F.col("u").alias("node")), "node", "left_anti")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean over all nodes of the share of neighbour pairs that are joined; 0 for degree < 2."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    d = F.col("degree")
    local = F.when(d >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return degrees(nodes, edges).join(t, "node", "left").agg(F.avg(local).alias("clustering"))


def homophily(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the share of edges whose ends have one label; 0 without edges."""
    of = nodes.select("node", "label")
    j = edges.join(of.toDF("u", "lu"), "u").join(of.toDF("v", "lv"), "v")
    return j.agg(F.coalesce(F.avg(F.when(F.col("lu") == F.col("lv"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("homophily"))


def degree_distances(nodes: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: total variation and Jensen-Shannon divergence (natural log) of two graphs' degree distributions."""

    def shares(edges: DataFrame, name: str) -> DataFrame:
        h = degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("n"))
        return h.select("degree", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias(name))

    j = shares(one, "p").join(shares(two, "q"), "degree", "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / m)).otherwise(0.0)
    return j.agg(
        F.coalesce(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, F.lit(0.0)).alias("tv"),
        F.coalesce((F.sum(term("p")) + F.sum(term("q"))) / 2, F.lit(0.0)).alias("js"),
    )


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among nodes(node), re-indexed from 0 in the order of node."""
    place = nodes.select("node", (F.row_number().over(W.orderBy("node")).cast("long") - 1).alias("i"))
    return edges.join(place.toDF("u", "iu"), "u").join(place.toDF("v", "iv"), "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"))


def remove_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that aren't in `removed`, whichever way its pairs are written."""
    r = removed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return edges.join(r, ["u", "v"], "left_anti")


def split_budget(total: int, rounds: int) -> list[int]:
    """`total` over rounds: equal shares, the first total % rounds rounds one more."""
    base, more = divmod(total, rounds)
    return [base + (k < more) for k in range(rounds)]


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, wedges, triangles, mean and greatest degree."""
    d = F.col("degree")
    by_node = degrees(nodes, edges).agg(
        F.count("*").alias("nodes"), F.sum(F.expr("degree * (degree - 1) div 2")).alias("wedges"), F.avg(d).alias("mean_degree"), F.max(d).alias("max_degree")
    )
    return by_node.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(triangles(edges).agg(F.count("*").alias("triangles")))


def degeneracy(edges: DataFrame) -> int:
    """The greatest k with a subgraph of least degree k, by peeling; rounds are stored in the shared folder."""
    from lattica.session import materialize

    left, k = materialize(edges.select("u", "v"), "peel"), 0
    while left.limit(1).count():
        d = bidirectional(left).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("d"))
        low = d.filter(F.col("d") <= k).select("node")
        if not low.limit(1).count():
            k += 1
            continue
        left = materialize(left.join(low.toDF("u"), "u", "left_anti").join(low.toDF("v"), "v", "left_anti").select("u", "v"), "peel")
    return k


def edge_hash(edges: DataFrame) -> DataFrame:
    """One row: SHA-256 of the edge list in order. Gathers the list: for graphs that fit a task."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("u", "v"))), lambda e: F.concat_ws(",", e["u"], e["v"]))
    return edges.agg(F.sha2(F.array_join(text, ";"), 256).alias("sha256"))


def jaccard(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: shared edges, edges of either, and their ratio (1 for two empty sets)."""
    j = one.select("u", "v", F.lit(1).alias("a")).join(two.select("u", "v", F.lit(1).alias("b")), ["u", "v"], "full_outer")
    both, either = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)), F.count("*")
    return j.agg(both.alias("shared"), either.alias("either"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


def component_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of components (isolated nodes count) and the largest one's share of nodes."""
    from lattica.operators.components import connected_components

    c = nodes.select("node").join(connected_components(edges), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("components"), F.coalesce(F.max("n") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("largest_ratio"))


def bridges(edges: DataFrame) -> DataFrame:
    """Edges whose removal splits their component.

    An edge in a triangle is none. The rest is decided by depth-first low-links
    in one task a component, which is bounded by the largest component.
    """
    from lattica.operators.components import connected_components

    c = connected_components(edges)
    of = edges.join(c.withColumnRenamed("node", "u"), "u")

    def low_links(pdf):
        around: dict[int, list[int]] = {}
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            around.setdefault(u, []).append(v)
            around.setdefault(v, []).append(u)
        root = min(around)
        seen, low, found = {root: 0}, {root: 0}, []
        stack = [(root, -1, iter(around[root]))]
        while stack:
            x, parent, rest = stack[-1]
            for y in rest:
                if y not in seen:
                    seen[y] = low[y] = len(seen)
                    stack.append((y, x, iter(around[y])))
                    break
                if y != parent:
                    low[x] = min(low[x], seen[y])
            else:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[x])
                    if low[x] > seen[parent]:
                        found.append((min(x, parent), max(x, parent)))
        out = pdf.iloc[: len(found)][["u", "v"]].copy()
        out["u"], out["v"] = [e[0] for e in found], [e[1] for e in found]
        return out

    return of.groupBy("component").applyInPandas(low_links, "u long, v long")
