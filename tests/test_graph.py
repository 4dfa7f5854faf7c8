"""Graph algebra and orbits on small graphs with known values and against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from lattica.operators import graph as G
from lattica.operators import orbits as O
from lattica.operators import scoring as S
from lattica.operators import selectors as B
from lattica.operators import tables as T
from lattica.operators.components import connected_components

GOLDEN = {
    "paw": ("01 02 12 23", {0: "2 1 0 1 0 0 0 0 0 0 1 0 0 0 0", 2: "3 0 2 1 0 0 0 0 0 0 0 1 0 0 0", 3: "1 2 0 0 0 0 0 0 0 1 0 0 0 0 0"}),
    "diamond": ("01 02 12 13 23", {0: "2 2 0 1 0 0 0 0 0 0 0 0 1 0 0", 1: "3 0 1 2 0 0 0 0 0 0 0 0 0 1 0"}),
    "k4": ("01 02 03 12 13 23", {0: "3 0 0 3 0 0 0 0 0 0 0 0 0 0 1"}),
    "c5": ("01 12 23 34 04", {0: "2 2 1 0 2 2 0 0 0 0 0 0 0 0 0"}),
}


def frames(spark, pairs, n):
    return spark.range(n).toDF("node"), spark.createDataFrame([tuple(p) for p in pairs], "u long, v long")


def gdv_of(df):
    return {r["node"]: [r[f"o{k}"] for k in range(15)] for r in df.collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    text, want = GOLDEN[name]
    pairs = [(int(e[0]), int(e[1])) for e in text.split()]
    nodes, edges = frames(spark, pairs, max(map(max, pairs)) + 1)
    got = gdv_of(O.gdv_closed(nodes, edges))
    assert got == gdv_of(O.wide(O.gdv_long(nodes, O.graphlets(edges))))
    for node, row in want.items():
        assert got[node] == [int(x) for x in row.split()]


def brute(n, pairs):
    adj = {x: set() for x in range(n)}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    role = {(s, m, p): o for s, m, p, o in O.masks()}
    out = {x: [0] * 15 for x in range(n)}
    for size in (2, 3, 4):
        for nodes in combinations(range(n), size):
            mask = sum(1 << k for k, (i, j) in enumerate(O.PAIRS) if j < size and nodes[j] in adj[nodes[i]])
            for p, x in enumerate(nodes):
                if (size, mask, p) in role:
                    out[x][role[size, mask, p]] += 1
    return out


def random_graph(n, share, seed):
    rng = random.Random(seed)
    return [p for p in combinations(range(n), 2) if rng.random() < share]


@pytest.mark.parametrize("seed", range(3))
def test_gdv_brute_force(spark, seed):
    pairs = random_graph(9, 0.25 + 0.2 * seed, seed)
    nodes, edges = frames(spark, pairs, 9)
    want = brute(9, pairs)
    assert gdv_of(O.gdv_closed(nodes, edges)) == want
    assert gdv_of(O.wide(O.gdv_long(nodes, O.graphlets(edges)))) == want


def test_delta_is_recount(spark):
    pairs = random_graph(8, 0.45, 5)
    nodes, edges = frames(spark, pairs, 8)
    moves = S.transitions(O.graphlets(edges))
    got = {}
    for r in S.raw_delta(moves).collect():
        got.setdefault((r["u"], r["v"]), {})[r["node"], r["orbit"]] = r["delta"]
    base = brute(8, pairs)
    for e in pairs:
        after = brute(8, [p for p in pairs if p != e])
        want = {(x, o): after[x][o] - base[x][o] for x in range(8) for o in range(15) if after[x][o] != base[x][o]}
        assert got.get(e, {}) == want
    net = S.transition_summary(S.transition_matrix(moves)).collect()
    assert all(r["net"] == r["gain"] - r["loss"] for r in net)


def test_registry_and_masks():
    reg = O.registry()
    assert [r[0] for r in reg] == list(range(15))
    by_graphlet = {}
    for orbit, size, edges, multiplicity, degree in reg:
        by_graphlet.setdefault((size, edges), []).append((multiplicity, degree))
    assert sum(m * d for m, d in by_graphlet[4, 6]) == 12  # handshakes
    assert sorted(o for own in O.GROUPS.values() for o in own) == list(range(15))


def test_canonical(spark):
    raw = spark.createDataFrame([(1, 0), (0, 1), (2, 2), (3, 1)], "u long, v long")
    assert sorted(map(tuple, G.canonical_edges(raw).collect())) == [(0, 1), (1, 3)]
    with pytest.raises(Exception, match="out of range"):
        G.canonical_edges(raw, nodes=3).collect()


def test_components_and_bridges(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (4, 5)]
    nodes, edges = frames(spark, pairs, 7)
    assert dict(map(tuple, connected_components(edges).collect())) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    assert sorted(map(tuple, G.bridges(edges).collect())) == [(2, 3), (4, 5)]
    s = G.component_summary(nodes, edges).first()
    assert (s["components"], s["largest_ratio"]) == (3, 4 / 7)
    assert G.degeneracy(edges) == 2


def test_long_path_components(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_empty_graph(spark):
    nodes, edges = frames(spark, [], 3) if False else (spark.range(3).toDF("node"), spark.createDataFrame([], "u long, v long"))
    assert gdv_of(O.gdv_closed(nodes, edges)) == {k: [0] * 15 for k in range(3)}
    assert G.homophily(nodes.selectExpr("node", "'a' as label"), edges).first()[0] == 0.0
    assert connected_components(edges).count() == 0
    assert G.bridges(edges).count() == 0
    kept, gone = S.batch_prune(nodes, edges, 0.5, 2)
    assert kept.count() == 0 and gone.count() == 0


def test_batch_prune(spark):
    pairs = random_graph(10, 0.5, 3)
    nodes, edges = frames(spark, pairs, 10)
    kept, gone = S.batch_prune(nodes, edges, 0.2, 2, d_min=1)
    assert kept.count() + gone.count() == len(pairs)
    assert gone.count() == round(len(pairs) * 0.2)
    kept, gone = S.batch_prune(nodes, edges, 0.0, 2)
    assert kept.count() == len(pairs)


def test_guards(spark):
    nodes, edges = frames(spark, [(0, 1), (1, 2), (0, 2), (2, 3)], 4)
    got = {(r["u"], r["v"]): r["reason"] for r in S.guard_reasons(nodes, edges, 1, G.bridges(edges)).collect()}
    assert got == {(0, 1): "eligible", (0, 2): "eligible", (1, 2): "eligible", (2, 3): "bridge_guard"}


def test_selectors(spark):
    nodes, edges = frames(spark, random_graph(12, 0.4, 1), 12)
    w = B.dspar(nodes, edges, 0.5).collect()
    assert w and all(r["weight"] > 0 for r in w)
    assert B.sample_budget(1, 0.5) == 0
    with pytest.raises(ValueError):
        B.sample_budget(5, 0)
    assert B.lsh_dims(10, 0.25) == 2 and B.lsh_dims(10, 7) == 7 and B.lsh_dims(10, 0.01) == 1
    features = nodes.selectExpr("node", "array(cast(node % 5 as double), cast(node as double)) as features")
    kept = B.lsp(edges, features, 2, 3, 0.5, 1.0)
    assert kept.subtract(edges).count() == 0 and 0 < kept.count() <= edges.count()
    with pytest.raises(ValueError):
        B.lsp(edges, features, 2, 0, 0.5, 1.0)


def test_checkpoint_targets_and_budget():
    assert T.checkpoint_targets(10, 0.3, [0.3, 0.29, 0.9]) == [(0, [0.0]), (3, [0.29, 0.3])]
    assert G.split_budget(7, 3) == [3, 2, 2]


def greedy(pairs, n, budget, mode, d_min, guard):
    """Sequential pruning of the whole graph at once, every score anew at each step."""
    import math

    from lattica.operators.sequential import is_bridge

    def adjacency(es):
        a = {x: set() for x in range(n)}
        for u, v in es:
            a[u].add(v)
            a[v].add(u)
        return a

    base = brute(n, pairs)
    logs = [[math.log1p(base[x][o]) for x in range(n)] for o in range(15)]
    mu = [sum(c) / n for c in logs]
    sd = [max((sum((v - m) ** 2 for v in c) / n) ** 0.5, 0) for c, m in zip(logs, mu)]
    sd = [s if s >= 1e-12 else 1.0 for s in sd]
    z = lambda row: [(math.log1p(c) - m) / s for c, m, s in zip(row, mu, sd)]
    left, out = sorted(pairs), []
    ids = {e: k for k, e in enumerate(left)}
    for _ in range(budget):
        now, a, best = brute(n, left), adjacency(left), None
        for e in left:
            if (guard and is_bridge(a, *e)) or min(len(a[e[0]]), len(a[e[1]])) - 1 < d_min:
                continue
            after, total = brute(n, [p for p in left if p != e]), 0
            for x in e:
                shift = sum(abs(p - q) for p, q in zip(z(now[x]), z(after[x])))
                total += shift if mode == "absolute" else shift / (1e-8 + sum(map(abs, z(now[x]))))
            key = (round(total / 2, 9), len(a[e[0]]) + len(a[e[1]]), len(a[e[0]] & a[e[1]]), ids[e])
            best = min(best, key) if best else key
        if best is None:
            break
        out.append(best[3])
        left = [e for e in left if ids[e] != best[3]]
    return out


@pytest.mark.parametrize("mode, d_min, guard", [("relative", 1, False), ("absolute", 0, True)])
def test_sequential_prune(spark, mode, d_min, guard):
    from lattica.operators.sequential import sequential_prune

    pairs = random_graph(7, 0.5, 4) + [(7 + a, 7 + b) for a, b in random_graph(5, 0.7, 2)]
    nodes, edges = frames(spark, pairs, 12)
    got = sequential_prune(nodes, edges, 0.4, mode, d_min, guard).orderBy("round").collect()
    assert [r["edge_id"] for r in got] == greedy(pairs, 12, round(len(pairs) * 0.4), mode, d_min, guard)


def test_regressions(spark):
    from lattica.operators import learning as L

    rng = random.Random(1)
    rows = [(k % 12, a := rng.gauss(0, 1), b := rng.gauss(3, 2), 2 * a - b + 1 + rng.gauss(0, 0.01)) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, a double, b double, y double")
    alpha, beta = L.grouped_ridge(df, ["a", "b"], "y", "g")
    assert alpha == 0.01 and beta == pytest.approx([1, 2, -1], abs=0.02)
    gain = {r["feature"]: r["increase"] for r in L.permutation_importance(df, ["a", "b"], beta, "y", "g", 1).collect()}
    assert gain["a"] > 0 and gain["b"] > 0
    s = L.bootstrap_spearman(df, "b", "y", "g", 10).first()
    assert -1 <= s["low"] <= s["rho"] <= s["high"] < 0
    assert s["rho"] == pytest.approx(T.spearman(df, "b", "y").first()["rho"])


def test_classifier_on_propagated_features(spark):
    from lattica.operators import learning as L

    pairs = [p for p in combinations(range(12), 2) if p[0] // 6 == p[1] // 6]
    nodes, edges = frames(spark, pairs, 12)
    features = nodes.selectExpr("node", "cast(node < 6 as double) + node % 3 as x", "cast(node div 6 as int) as label", "if(node % 3 = 0, 'test', 'train') as split")
    h = L.propagate(edges, features.select("node", "x"), nodes, "gcn", ["x"]).join(features.select("node", "label", "split"), "node")
    out = L.train_and_evaluate(h, ["x"]).filter("split = 'test'")
    assert T.classification(out, "label", "prediction").first()["accuracy"] == 1.0
    sage = L.propagate(edges, features.select("node", "x"), nodes, "sage", ["x"])
    assert sage.count() == 12


@pytest.mark.parametrize("seed", range(3))
def test_closed_deltas(spark, seed):
    from lattica.operators.edge_masks import endpoint_delta, mask_histogram

    pairs = random_graph(10, 0.25 + 0.2 * seed, 20 + seed) + [(0, k) for k in range(10, 14)]
    pairs = sorted(set(pairs))
    nodes, edges = frames(spark, pairs, 14)
    key = lambda df: sorted(map(tuple, df.select("u", "v", "node", "orbit", "delta").collect()))
    assert key(endpoint_delta(mask_histogram(nodes, edges))) == key(S.raw_delta(S.transitions(O.graphlets(edges)), endpoints_only=True))


def test_rounds_are_recorded(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "u long, v long")
    nodes = spark.range(4).toDF("node")
    left, gone, records = S.batch_rounds(nodes, edges, 1.0, 2, d_min=1, guard_bridges=True)
    got = [tuple(r) for r in records.orderBy("round").collect()]
    # the triangle's edges go in the first round, all but one of them within its budget of 2; then two bridges are left
    assert got == [(1, 2, 4, 3, 1, 0, 2, 2), (2, 2, 2, 0, 2, 0, 0, 2)]
    assert gone.count() == 2 and left.count() == 2
    assert tuple(S.round_summary(records, 4).first()) == (4, 2, 2, True, 0.5)


def test_manifest_rejects(spark):
    rows = [(0.1, 0.004, False, "a"), (0.105, 0.001, False, "a"), (0.2, 0.001, True, "b"), (0.3, 0.006, False, "c"), (0.305, 0.001, False, "c"), (0.4, 0.0, False, "d")]
    m = spark.createDataFrame(rows, "target double, abs_gap double, saturated boolean, run string")
    got = {r["target"]: r["reason"] for r in T.manifest_reasons(m, "run").collect()}
    assert got == {0.1: "artifact_matched_twice", 0.105: "artifact_matched_twice", 0.2: "saturated", 0.3: "target_gap", 0.305: "accepted", 0.4: "accepted"}


def test_repeats_are_the_reference_s(spark):
    import inspect

    from lattica.operators import learning as L

    df = spark.createDataFrame([(k % 5, float(k), float(10 * (k * k % 7))) for k in range(30)], "g long, a double, y double")
    got = L.permutation_importance(df, ["a"], np.array([0.0, 1.0]), "y", "g").collect()
    assert sorted(r["repeat"] for r in got) == list(range(32)) and len({r["increase"] for r in got}) > 3
    assert inspect.signature(L.bootstrap_spearman).parameters["repeats"].default == 200


def test_stored_counts_are_not_broadcast_for_their_small_files(spark, monkeypatch):
    from lattica import session
    from lattica.sources.graphs import ring

    monkeypatch.setattr(session, "BROADCAST_ROWS", 1000)
    edges, nodes = ring(spark, 100), spark.range(100).toDF("node")
    long = S.counts(nodes, edges)[1]
    assert long.count() == 1500
    plan = long.join(long.toDF("node", "orbit", "now"), ["node", "orbit"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    kept, gone = S.batch_prune(nodes, edges, 0.1, 2, d_min=1)
    again = S.batch_prune(nodes, edges, 0.1, 2, d_min=1, counted=S.counts(nodes, edges))
    assert gone.count() == 20 and sorted(kept.collect()) == sorted(again[0].collect()) and sorted(gone.collect()) == sorted(again[1].collect())
