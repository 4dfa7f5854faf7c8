"""Nearest vectors over several blocks: recall, repeated ids and ties across blocks."""

from __future__ import annotations

import numpy as np

from lattica.llm import ann


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 150)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 24)).astype(np.float32)
    x[300:420] = x[300] * 3  # ties over all blocks, nearest to many
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[8].tolist()), (20, x[21].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    out = ann.search(df, df["vec_id"] % 20 == 0).collect()
    ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    hit = n = 0
    for q in sorted({k for k in range(0, 1200, 20)} - {20}):  # 20 asks twice, with two vectors
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        s = (y * y[q]).sum(axis=1)
        others = np.flatnonzero(ids != q)
        best = others[np.lexsort((ids[others], -s[others]))][:20]
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] <= b[1]) for a, b in zip(own, own[1:]))
        hit += len({(int(ids[b]), s[b]) for b in best} & {(v, score) for _, v, score in own})
        n += 20
    assert hit / n >= 0.9
    assert {r["query_id"] for r in out} == set(range(0, 1200, 20))
