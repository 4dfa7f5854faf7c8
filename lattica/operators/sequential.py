"""Exact sequential pruning: one edge at a time, always the one with the least key.

An edge's score, guards and deltas depend on its own connected component and on
the original graph's statistics alone. So each initial component is pruned in a
task of its own, and the components' sequences are merged: taking the least
head of many sequences again and again is sorting by the running maximum of the
key within each (Window over a struct), then by step.

The task's memory and time are bounded by its component and the budget.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators.components import connected_components
from lattica.operators.graph import edge_ids
from lattica.operators.orbits import ORBITS, PAIRS, gdv_closed, masks, standardization, to_long
from lattica.session import materialize

_ROLE = {(size, mask, place): orbit for size, mask, place, orbit in masks()}


def relevant_subsets(around: dict[int, set[int]], u: int, v: int):
    """Connected sets of 2 to 4 nodes that hold the edge: the pair, with a neighbour, with two neighbours or one and its own."""
    near = (around[u] | around[v]) - {u, v}
    yield (u, v)
    for a in near:
        yield (u, v, a)
    for a, b in combinations(sorted(near), 2):
        yield (u, v, a, b)
    for a in near:
        for b in around[a] - near - {u, v}:
            yield (u, v, a, b)


def mask_of(nodes: tuple[int, ...], around: dict[int, set[int]]) -> int:
    n = len(nodes)
    return sum(1 << k for k, (i, j) in enumerate(PAIRS) if j < n and nodes[j] in around[nodes[i]])


def deletion_delta(around: dict[int, set[int]], u: int, v: int) -> dict[int, list[int]]:
    """What deleting (u, v) does to the counts of each node around it."""
    out: dict[int, list[int]] = {}
    for nodes in relevant_subsets(around, u, v):
        mask, n = mask_of(nodes, around), len(nodes)
        for p, x in enumerate(nodes):
            d = out.setdefault(x, [0] * ORBITS)
            d[_ROLE[n, mask, p]] -= 1
            after = _ROLE.get((n, mask & ~1, p))  # places 0 and 1 are u and v, whose bit is the first
            if after is not None:
                d[after] += 1
    return out


def is_bridge(around: dict[int, set[int]], u: int, v: int) -> bool:
    """Whether u and v are joined by the edge alone: not with a common neighbour; surely if either has no other; else by search."""
    if around[u] & around[v]:
        return False
    if len(around[u]) <= 1 or len(around[v]) <= 1:
        return True
    seen, todo = {u}, [y for y in around[u] if y != v]
    seen.update(todo)
    while todo:
        x = todo.pop()
        if x == v:
            return False
        for y in around[x]:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return v not in seen


def prune_component(edges: list[tuple[int, int, int]], raw: dict[int, list[int]], stats: list[tuple[float, float]], budget: int, mode: str, d_min: int, guard_bridges: bool, weights: list[float], eps: float = 1e-8):
    """(step, edge id, u, v, key parts) of up to `budget` deletions; edges are (edge id, u, v)."""
    around: dict[int, set[int]] = {}
    for _, u, v in edges:
        around.setdefault(u, set()).add(v)
        around.setdefault(v, set()).add(u)
    z = lambda c, o: (math.log1p(max(c, 0)) - stats[o][0]) / stats[o][1]

    def score(u: int, v: int) -> float:
        delta = deletion_delta(around, u, v)
        total = 0.0
        for x in (u, v):
            shift = sum(w * abs(z(c, o) - z(c + d, o)) for o, (w, c, d) in enumerate(zip(weights, raw[x], delta[x])) if d)
            total += shift if mode == "absolute" else shift / (eps + sum(w * abs(z(c, o)) for o, (w, c) in enumerate(zip(weights, raw[x]))))
        return total / 2

    left = {e: (u, v) for e, u, v in edges}
    scores: dict[int, float] = {}
    blocked: set[int] = set()  # guards never lift: deletions lower degrees and make bridges
    for step in range(1, budget + 1):
        best = None
        for e, (u, v) in left.items():
            if e in blocked:
                continue
            if e not in scores:
                scores[e] = score(u, v)
            key = (scores[e], len(around[u]) + len(around[v]), len(around[u] & around[v]), e)
            if best is None or key < best:
                if (guard_bridges and is_bridge(around, u, v)) or min(len(around[u]), len(around[v])) - 1 < d_min:
                    blocked.add(e)
                    continue
                best = key
        if best is None:
            return
        e = best[3]
        u, v = left.pop(e)
        yield (step, e, u, v, *best[:3])
        delta = deletion_delta(around, u, v)
        around[u].discard(v)
        around[v].discard(u)
        for x, d in delta.items():
            raw[x] = [c + k for c, k in zip(raw[x], d)]
        for f, (a, b) in left.items():  # what shares a graphlet with the deleted edge has both ends among the changed
            if a in delta or b in delta:
                scores.pop(f, None)


def sequential_prune(nodes: DataFrame, edges: DataFrame, rho: float, mode: str = "relative", d_min: int = 2, guard_bridges: bool = False, weights: list[float] | None = None) -> DataFrame:
    """round, edge_id, u, v, score, degree, support of the deletions, in order; the trajectory of a lesser rho is its beginning."""
    edges = materialize(edge_ids(edges.select("u", "v")), "edges")
    budget = round(edges.count() * rho)
    long = materialize(to_long(gdv_closed(nodes, edges)), "gdv")
    stats = [(r["mu"], r["sd"]) for r in standardization(long).orderBy("orbit").collect()]
    w = weights or [1.0] * ORBITS
    counts = long.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("orbit", "cnt"))), lambda s: s["cnt"]).alias("raw"))
    of = connected_components(edges)
    ends = edges.join(of.toDF("u", "component"), "u").join(counts.toDF("u", "raw_u"), "u").join(counts.toDF("v", "raw_v"), "v")
    fields = "component long, step int, edge_id long, u long, v long, score double, degree long, support long"

    def run(pdf):
        import pandas as pd

        raw: dict[int, list[int]] = {}
        for u, v, a, b in zip(pdf["u"], pdf["v"], pdf["raw_u"], pdf["raw_v"]):
            raw[u], raw[v] = [int(x) for x in a], [int(x) for x in b]
        own = sorted(zip(pdf["edge_id"].tolist(), pdf["u"].tolist(), pdf["v"].tolist()))
        rows = [(pdf["component"].iloc[0], *r) for r in prune_component(own, raw, stats, budget, mode, d_min, guard_bridges, w)]
        return pd.DataFrame(rows, columns=["component", "step", "edge_id", "u", "v", "score", "degree", "support"])

    found = materialize(ends.select("component", "edge_id", "u", "v", "raw_u", "raw_v").groupBy("component").applyInPandas(run, fields), "sequences")
    key = F.struct("score", "degree", "support", "edge_id")
    top = F.max(key).over(W.partitionBy("component").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    merged = found.withColumn("top", top).orderBy("top", "step").limit(budget)
    return merged.select(F.row_number().over(W.orderBy("top", "step")).alias("round"), "edge_id", "u", "v", "score", "degree", "support")
