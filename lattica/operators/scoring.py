"""What deleting an edge does to orbit counts, edge scores, guards, and batch pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import degrees, remove_edges, split_budget, support
from lattica.operators.orbits import GROUPS, ORBITS, PAIRS, Parts, counting_parts, gdv_closed, mask_table, standardization, standardized, to_long
from lattica.session import discard, materialize, stored

DESTROYED = ORBITS


def transitions(found: DataFrame) -> DataFrame:
    """u, v, node, src, dst: each node's role in each graphlet before and after an edge of it is deleted; dst 15: destroyed."""
    table = mask_table(found.sparkSession)
    slots = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.get("n", F.lit(a)).alias("u"), F.get("n", F.lit(b)).alias("v")) for k, (a, b) in enumerate(PAIRS)])
    hit = found.select("size", "n", "mask", F.explode(slots).alias("s")).filter("(mask & s.bit) <> 0")  # a slot beyond the graphlet has no bit
    cut = hit.select("size", "n", "s.u", "s.v", "mask", F.expr("mask & ~s.bit").alias("left"))
    before = cut.join(F.broadcast(table.withColumnRenamed("orbit", "src")), ["size", "mask"])
    after = F.broadcast(table.toDF("size", "left", "place", "dst"))
    j = before.join(after, ["size", "left", "place"], "left")
    return j.select("u", "v", F.expr("n[place]").alias("node"), "src", F.coalesce("dst", F.lit(DESTROYED)).alias("dst"))


def raw_delta(moves: DataFrame, endpoints_only: bool = False) -> DataFrame:
    """u, v, node, orbit and delta of the counts when edge (u, v) is deleted, where it isn't 0."""
    if endpoints_only:
        moves = moves.filter("node = u or node = v")
    lost = moves.select("u", "v", "node", F.col("src").alias("orbit"), F.lit(-1).alias("delta"))
    won = moves.filter(F.col("dst") < DESTROYED).select("u", "v", "node", F.col("dst").alias("orbit"), F.lit(1).alias("delta"))
    d = lost.unionByName(won).groupBy("u", "v", "node", "orbit").agg(F.sum("delta").cast("long").alias("delta"))
    return d.filter("delta <> 0")


def transition_matrix(moves: DataFrame) -> DataFrame:
    """u, v, src, dst, n: the matrix of each edge's deletion."""
    return moves.groupBy("u", "v", "src", "dst").agg(F.count("*").alias("n"))


def transition_summary(matrix: DataFrame) -> DataFrame:
    """u, v, orbit, loss, gain, net: what leaves and what enters an orbit, without what stays."""
    moved = matrix.filter("src <> dst")
    out = moved.groupBy("u", "v", F.col("src").alias("orbit")).agg(F.sum("n").alias("loss"))
    into = moved.filter(F.col("dst") < DESTROYED).groupBy("u", "v", F.col("dst").alias("orbit")).agg(F.sum("n").alias("gain"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.join(into, ["u", "v", "orbit"], "full_outer").select("u", "v", "orbit", z("loss").alias("loss"), z("gain").alias("gain"), (z("gain") - z("loss")).alias("net"))


def event_faults(matrix: DataFrame, delta: DataFrame) -> DataFrame:
    """u, v of edges whose matrix of moves (u, v, src, dst, n) gives an orbit another net change than `delta` (u, v, orbit, delta) has."""
    net = transition_summary(matrix).select("u", "v", "orbit", "net").filter("net <> 0")
    both = net.join(delta.filter("delta <> 0"), ["u", "v", "orbit"], "full_outer")
    return both.filter("not (net <=> delta)").select("u", "v").distinct()


def edge_scores(edges: DataFrame, long: DataFrame, stats: DataFrame, delta: DataFrame, mode: str = "relative", eps: float = 1e-8, weights: DataFrame | None = None) -> DataFrame:
    """u, v, score, mean_abs, mean_rel, mean_denom, min_denom of each edge.

    `delta` are the endpoints' raw deltas; `stats` stay those of the original
    graph; `weights` (orbit, w) default to 1. With every orbit's z before and
    after, an endpoint's shift is the weighted sum of |z - z'|, its denominator
    eps plus the weighted sum of |z|; an edge takes the mean over its ends.
    """
    if mode not in ("absolute", "relative"):
        raise ValueError(mode)
    z = standardized(long, stats)
    z = z.join(F.broadcast(weights), "orbit") if weights is not None else z.withColumn("w", F.lit(1.0))
    denom = z.groupBy("node").agg((F.lit(eps) + F.sum(F.col("w") * F.abs("z"))).alias("denom"))
    after = (F.log1p(F.greatest(F.col("cnt") + F.col("delta"), F.lit(0)).cast("double")) - F.col("mu")) / F.col("sd")
    moved = delta.join(z, ["node", "orbit"]).join(F.broadcast(stats), "orbit")
    shift = moved.groupBy("u", "v", "node").agg(F.sum(F.col("w") * F.abs(F.col("z") - after)).alias("shift"))
    ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("node")).join(denom, "node").join(shift, ["u", "v", "node"], "left")
    s = F.coalesce(F.col("shift"), F.lit(0.0))
    out = ends.groupBy("u", "v").agg(
        F.avg(s).alias("mean_abs"), F.avg(s / F.col("denom")).alias("mean_rel"), F.avg("denom").alias("mean_denom"), F.min("denom").alias("min_denom")
    )
    return out.withColumn("score", F.col("mean_abs" if mode == "absolute" else "mean_rel"))


def guard_reasons(nodes: DataFrame, edges: DataFrame, d_min: int = 2, bridge_edges: DataFrame | None = None) -> DataFrame:
    """u, v, degree (sum of both ends') and reason: bridge_guard first, then d_min_guard, else eligible."""
    d = degrees(nodes, edges)
    j = edges.select("u", "v").join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    j = j.join(bridge_edges.select("u", "v", F.lit(True).alias("b")), ["u", "v"], "left") if bridge_edges is not None else j.withColumn("b", F.lit(None).cast("boolean"))
    reason = F.when(F.col("b"), "bridge_guard").when(F.least("du", "dv") - 1 < d_min, "d_min_guard").otherwise("eligible")
    return j.select("u", "v", (F.col("du") + F.col("dv")).alias("degree"), reason.alias("reason"))


def ranked_candidates(nodes: DataFrame, edges: DataFrame, scores: DataFrame, d_min: int, bridge_edges: DataFrame | None = None) -> DataFrame:
    """Eligible edges with the key that selection follows: score, degree, support, then (u, v), the order of edge ids."""
    return _ranked(scores, guard_reasons(nodes, edges, d_min, bridge_edges), support(edges))


def _ranked(scores: DataFrame, reasons: DataFrame, supports: DataFrame) -> DataFrame:
    ok = reasons.filter("reason = 'eligible'")
    return scores.join(ok, ["u", "v"]).join(supports, ["u", "v"]).select("u", "v", "score", "degree", "support")


def best_edge(ranked: DataFrame) -> DataFrame:
    """The first of `ranked_candidates` in selection's order, or no row: partial minima, then one."""
    key = ("score", "degree", "support", "u", "v")
    return ranked.agg(F.min(F.struct(*key)).alias("b")).filter("b is not null").select(*[F.col(f"b.{c}") for c in ("u", "v", "score", "degree", "support")])


def counts(nodes: DataFrame, edges: DataFrame) -> tuple[Parts, DataFrame]:
    """A graph's parts and its counts (node, orbit, cnt), stored."""
    parts = counting_parts(nodes, edges)
    return parts, stored(to_long(gdv_closed(nodes, parts.edges, parts)), "gdv")


def resolve_engine(requested: str, budgets: list[int]) -> str:
    """`sequential` or `batch` for the budgets of rounds; a sequential engine takes one edge a round at most."""
    if requested not in ("auto", "sequential", "batch"):
        raise ValueError(f"unknown engine {requested!r}")
    single = all(b <= 1 for b in budgets)
    if requested == "sequential" and not single:
        raise ValueError("a sequential engine takes one edge a round")
    return requested if requested != "auto" else "sequential" if single else "batch"


def batch_prune(nodes: DataFrame, edges: DataFrame, rho: float, rounds: int, mode: str = "relative", d_min: int = 2, guard_bridges: bool = False, weights: DataFrame | None = None, counted: tuple[Parts, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept and removed edges (removed: round, u, v, score) after `rounds` rounds of batch pruning.

    Guards hold at the start of a round only, so a round's deletions together
    may go below d_min. A round without eligible edges is skipped and its
    budget isn't given to others. Each round counts its graph anew in closed
    form; nothing is enumerated. counted: the first graph's parts and stored
    counts (node, orbit, cnt), where the caller has them.
    """
    return batch_rounds(nodes, edges, rho, rounds, mode, d_min, guard_bridges, weights, counted)[:2]


def batch_rounds(nodes: DataFrame, edges: DataFrame, rho: float, rounds: int, mode: str = "relative", d_min: int = 2, guard_bridges: bool = False, weights: DataFrame | None = None, counted: tuple[Parts, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `batch_prune` gives, and a record of each round: round, requested, active_before, eligible, blocked_by_bridge, blocked_by_d_min, selected, remaining."""
    from lattica.operators.graph import bridges

    from lattica.operators.edge_masks import endpoint_delta, mask_histogram

    spark = edges.sparkSession
    left = counted[0].edges if counted else stored(edges.select("u", "v"), "edges")
    stats: DataFrame | None = None
    removed: list[DataFrame] = []
    records: list[tuple[int, ...]] = []
    for number, budget in enumerate(split_budget(round(left.count() * rho), rounds), 1):
        if not budget:
            continue
        own = not counted
        parts, long = counted or counts(nodes, left)
        counted = None
        stats = materialize(standardization(long), "stats") if stats is None else stats
        # stored one by one: in one plan they keep more of the driver's memory than the tables need
        histogram = stored(mask_histogram(nodes, left, parts), "shapes")
        delta = stored(endpoint_delta(histogram), "delta")
        scores = stored(edge_scores(left, long, stats, delta, mode, weights=weights), "scores")
        barred = materialize(bridges(left).select("u", "v"), "bridges") if guard_bridges else None
        guards = stored(guard_reasons(nodes, left, d_min, barred), "guards")
        reasons = {r["reason"]: r["n"] for r in guards.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        ranked = _ranked(scores, guards, parts.support)
        gone = materialize(ranked.orderBy("score", "degree", "support", "u", "v").limit(budget).select(F.lit(number).alias("round"), "u", "v", "score"), "removed")
        removed.append(gone)
        before, left = left, stored(remove_edges(left, gone), "edges")
        active, chosen = sum(reasons.values()), gone.count()
        records.append((number, budget, active, reasons.get("eligible", 0), reasons.get("bridge_guard", 0), reasons.get("d_min_guard", 0), chosen, active - chosen))
        discard(spark, histogram, delta, scores, guards, *((before, long, *parts) if own else ()))
    every = removed[0] if removed else left.select(F.lit(0).alias("round"), "u", "v", F.lit(0.0).alias("score")).limit(0)
    for more in removed[1:]:
        every = every.unionByName(more)
    names = ("round", "requested", "active_before", "eligible", "blocked_by_bridge", "blocked_by_d_min", "selected", "remaining")
    return left, every, spark.createDataFrame(records, ", ".join(f"{n} long" for n in names))


def round_summary(records: DataFrame, edges: int) -> DataFrame:
    """One row for rounds of `batch_rounds` on a graph of so many edges: requested, removed, shortfall, ceiling_hit (the guards left less than was asked for) and achieved."""
    out = records.agg(F.coalesce(F.sum("requested"), F.lit(0)).alias("requested"), F.coalesce(F.sum("selected"), F.lit(0)).alias("removed"))
    short = F.col("requested") - F.col("removed")
    return out.select("*", short.alias("shortfall"), (short > 0).alias("ceiling_hit"), (F.col("removed") / F.lit(max(edges, 1))).alias("achieved"))


def structural_metrics(one: DataFrame, two: DataFrame, stats: DataFrame, eps: float = 1e-8) -> DataFrame:
    """One row: mean and median over nodes of the L1 distance of standardised counts, absolute and relative to the first graph's."""
    a, b = standardized(one, stats), standardized(two, stats).select("node", "orbit", F.col("z").alias("y"))
    per = a.join(b, ["node", "orbit"]).groupBy("node").agg(F.sum(F.abs(F.col("z") - F.col("y"))).alias("sig"), (F.lit(eps) + F.sum(F.abs("z"))).alias("norm"))
    rel = F.col("sig") / F.col("norm")
    return per.agg(F.avg("sig").alias("mean_delta_sig"), F.median("sig").alias("median_delta_sig"), F.avg(rel).alias("mean_delta_rel"), F.median(rel).alias("median_delta_rel"))


def checkpoint(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row an orbit: totals before and now, signed, absolute, relative, mean, greatest and L2 change, changed and nonzero nodes."""
    j = one.join(two.select("node", "orbit", F.col("cnt").alias("now")), ["node", "orbit"])
    d = F.col("now") - F.col("cnt")
    return j.groupBy("orbit").agg(
        F.sum("cnt").alias("initial_total"),
        F.sum("now").alias("current_total"),
        F.sum(d).alias("signed_delta"),
        F.sum(F.abs(d)).alias("abs_delta"),
        (F.sum(d) / F.greatest(F.abs(F.sum("cnt")), F.lit(1))).alias("relative_delta"),
        F.avg(F.abs(d).cast("double")).alias("mean_abs_delta"),
        F.max(F.abs(d)).alias("max_abs_delta"),
        F.count(F.when(d != 0, 1)).alias("changed_nodes"),
        F.count(F.when(F.col("now") != 0, 1)).alias("nonzero_nodes"),
        F.sqrt(F.sum((d * d).cast("double"))).alias("l2"),
    )


def leave_out_weights(spark) -> DataFrame:
    """variant, orbit, w: uniform, without each orbit, without each group; 22 variants."""
    rows = [("uniform", k, 1.0) for k in range(ORBITS)]
    rows += [(f"leave_orbit_{o}", k, float(k != o)) for o in range(ORBITS) for k in range(ORBITS)]
    rows += [(f"leave_{g}", k, float(k not in own)) for g, own in GROUPS.items() for k in range(ORBITS)]
    return spark.createDataFrame(rows, "variant string, orbit int, w double")


def normalized_weights(weights: DataFrame, how: str, by: list[str] | None = None) -> DataFrame:
    """Weights as they are (`none`), with sum 1 (`sum_one`) or with mean 1 (`mean_one`), for each value of `by`."""
    from pyspark.sql import Window as W

    total = F.sum("w").over(W.partitionBy(*(by or [F.lit(0)])))
    factor = {"none": F.lit(1.0), "sum_one": 1 / total, "mean_one": ORBITS / total}[how]
    return weights.withColumn("w", F.col("w") * factor)
