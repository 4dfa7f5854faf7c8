"""Configurations, weights, text formats, manifests and calibrations."""

from __future__ import annotations

import json

import pytest

from lattica.operators import orbits as O
from lattica.plans import pipelines as P
from lattica.session import scratch
from lattica.sources import artifacts as A
from lattica.sources.graphs import load_graph, ring, star


def test_config():
    c = A.load_config(json.dumps({"pruning": {"target_rho": 0.1, "recompute_rounds": 1.2, "new": 5}, "dataset": {"name": "gs"}}))
    assert c["pruning"].recompute_rounds == 2 and c["pruning"].options == {"new": 5} and c["dataset"].name == "gs"
    assert json.loads(A.resolved(c, 3))["seed"] == 3
    with pytest.raises(ValueError):
        A.load_config("[1]")
    with pytest.raises(ValueError):
        A.PruningConfig(target_rho=2)
    assert A.parse_float_sets(["GP:0.1,0.2"], {"gs": [0.3]}) == {"gs": [0.3], "gp": [0.1, 0.2]}
    with pytest.raises(ValueError):
        A.parse_filters(["x"])


def test_weights():
    w = A.resolve_weights(leave_groups=["cycle4"], normalize="sum_one")
    assert sum(w.weights) == pytest.approx(1) and w.weights[8] == 0
    assert A.OrbitWeights.load(w.dump()) .fingerprint() == w.fingerprint()
    with pytest.raises(ValueError):
        A.OrbitWeights((0.0,) * 15)
    with pytest.raises(ValueError):
        A.OrbitWeights.load(w.dump().replace("0.0714", "0.0715"))
    with pytest.raises(ValueError):
        A.resolve_weights([1.0] * 15, w.dump())


def test_unknown_graph(spark):
    with pytest.raises(ValueError):
        load_graph(spark, "/nowhere", "cora")


def test_text_formats(spark):
    edges = ring(spark, 6, (1,))
    path = scratch(spark, "graph")
    A.write_graph_text(spark, 6, edges, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[0] == "6 6" and len(lines) == 7
    counts = scratch(spark, "counts")
    spark.createDataFrame([(" ".join(["2"] * 15),)] * 2, "value string").coalesce(1).write.text(counts)
    assert A.read_counts_text(spark, counts, 2).count() == 2
    with pytest.raises(ValueError):
        A.read_counts_text(spark, counts, 3)


def test_manifest_and_ids(spark):
    path = scratch(spark, "files")
    spark.range(5).coalesce(1).write.parquet(path)
    listed = A.manifest(spark, path)
    from lattica.session import materialize

    listed = materialize(listed)
    assert A.verify_manifest(spark, listed, path).count() == 0
    spark.range(6).coalesce(1).write.mode("overwrite").parquet(path)
    assert A.verify_manifest(spark, listed, path).count() > 0
    c = spark.createDataFrame([(0, 3, 1), (1, 2, 0)], "orbit int, current_total long, abs_delta long")
    assert len(A.artifact_id(c, "gp").first()[0]) == 24


def test_runs(spark):
    path = scratch(spark, "runs")
    rows = spark.createDataFrame([("gp", "lsp", 1, 0.5), ("gs", "dspar", 2, 0.6)], "dataset string, method string, run long, accuracy double")
    A.write_runs(rows, path)
    assert spark.read.parquet(path).filter("method = 'lsp'").count() == 1
    with pytest.raises(Exception, match="missing"):
        A.canonical_runs(rows.drop("accuracy"), {"run": "bigint", "accuracy": "double"}, ("accuracy",)).collect()


def test_calibrations(spark):
    edges = ring(spark, 40)
    nodes = spark.range(40).toDF("node")
    got = {r["rho"]: r["removed"] for r in P.calibrate_orbit_shift(nodes, edges, [0.05, 0.1], d_min=1).collect()}
    assert got == {0.05: 4, 0.1: 8}
    eps = {r["epsilon"]: r["kept"] for r in P.calibrate_dspar(nodes, edges, [0.4, 0.9]).collect()}
    assert 0 < eps[0.9] <= eps[0.4] <= 80
    from lattica.operators.selectors import dspar

    assert dspar(nodes, edges, 0.9).count() == eps[0.9]
    assert P.refinements([(0.1, 0.05), (0.2, 0.3)], [0.06, 0.295, 0.1], [0.02]) == [0.08, 0.12]
    kept, row = P.prune_and_measure(nodes, edges, "sequential", 0.1, d_min=1)
    assert kept.count() == 72 and row.first()["achieved"] == pytest.approx(0.1)
    assert O.gdv_closed(nodes, star(spark, 40)).filter("node = 0").first()["o7"] == 39 * 38 * 37 // 6


def test_calibrations_refine(spark):
    edges = ring(spark, 40)
    nodes = spark.range(40).toDF("node")
    rho = {r["rho"]: r["removed"] for r in P.calibrate_orbit_shift(nodes, edges, [0.05, 0.1, 0.2], targets=[0.13, 0.2], d_min=1).collect()}
    assert rho == {0.05: 4, 0.08: 6, 0.09: 7, 0.1: 8, 0.11: 9, 0.12: 10, 0.2: 16}
    full = {r["rho"]: r["removed"] for r in P.calibrate_orbit_shift(nodes, edges, [0.1, 0.9], targets=[0.8], d_min=1).collect()}
    assert full.keys() == {0.1, 0.9} and full[0.9] < 72  # the guards left nothing: no refinement
    from lattica.operators.selectors import dspar

    eps = {r["epsilon"]: r["kept"] for r in P.calibrate_dspar(nodes, edges, [0.4, 0.9], targets=[0.3]).collect()}
    assert len(eps) == 12 and all(eps[e] == dspar(nodes, edges, e).count() for e in (0.4, 0.35, 0.9, 0.85) if e in eps)


def test_calibrate_lsp_is_both_variants_over_the_grid(spark):
    import random

    from lattica.operators.selectors import lsp

    rng = random.Random(3)
    edges = ring(spark, 60, (1, 2, 5, 7, 11))
    features = spark.createDataFrame([(k, [rng.gauss(1, 1) for _ in range(4)]) for k in range(60)], "node long, features array<double>")
    coarse = P.calibrate_lsp(edges, features, 4, targets=[]).collect()
    assert len(coarse) == 6 * 19 * 6 + 6 * 19
    out = P.calibrate_lsp(edges, features, 4, targets=[0.3]).collect()
    got = {(r["variant"], r["k"], r["sparsity"], r["step"]): r["kept"] for r in out}
    assert len(out) == len(got) and got.items() >= {(r["variant"], r["k"], r["sparsity"], r["step"]): r["kept"] for r in coarse}.items()
    assert all(n in got for v in "pt" for n in P.lsp_neighbours(min((s for s in got if s[0] == v and s[1] in P.LSP_KS and s[2] in P.LSP_SPARSITIES and (v == "t" or s[3] in P.LSP_STEPS)), key=lambda s: (abs(1 - got[s] / 300 - 0.3), s[1], s[2], s[3] or 0.0))))
    for v, k, share, step in (("p", 3, 0.5, 0.5), ("p", 1, 0.95, 4.0), ("p", 5, 0.25, 0.125), ("t", 2, 0.5, None), ("t", 5, 0.95, None), ("t", 1, 0.25, None)):
        assert got[v, k, share, step] == lsp(edges, features, 4, k, share, step, variant=v).count()


def test_uniforms_are_the_stream_and_first_draws_are_exact(spark):
    import numpy as np

    from lattica.operators import selectors as B

    want = np.random.RandomState(B.SAMPLER_SEED).random_sample(3000)
    rng = np.random.RandomState(B.SAMPLER_SEED)
    for start, stop in ((0, 1000), (1000, 3000)):
        got = sorted(map(tuple, B.uniforms(spark, rng, start, stop, chunk=300).collect()))
        assert got == list(enumerate(want.tolist()))[start:stop]
    hi = np.cumsum(np.arange(1, 41) / 820)
    cdf = spark.createDataFrame([(k, k + 1, float(h - (k + 1) / 820), float(h)) for k, h in enumerate(hi)], "u long, v long, lo double, hi double")
    firsts = B.first_draws(cdf, 40, spans=1, bits=64)
    of = np.minimum(np.searchsorted(hi, want), 39)
    for budget in (40, 500, 3000):
        drawn = {r["u"]: r["first"] for r in firsts(budget).collect() if r["first"] < budget}
        assert drawn == {int(e): int(np.flatnonzero(of[:budget] == e)[0]) for e in set(of[:budget].tolist())}
