"""Near-duplicates: documents of several rows, hot groups, and the bands' misses."""

from __future__ import annotations

import random

import pytest

from lattica.llm import near_dups
from tests.llm.test_operators import brute_components, chains, shingle_set

SCHEMA = "doc_id long, text string"


def test_repeated_ids_share_links(spark):
    """(1, A), (5, A), (5, B), (9, B) is one component, and so is a row of 5 without words."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (5, a), (5, b), (9, b), (5, ""), (5, None), (5, a), (12, "other text of its own"), (12, "other text of its own")]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(1, 1, True), (5, 1, False), (9, 1, False), (12, 12, True)}
    assert sorted((r["doc_id"], r["n_shingles"]) for r in out) == sorted((i, len(shingle_set(t))) for i, t in rows)


@pytest.mark.parametrize("blocks", [(2048, 512), (5, 4)])
def test_repeated_ids_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(near_dups, "GROUP_BLOCK", blocks[1])
    rng = random.Random(8)
    rows = [(i if rng.random() < 0.8 else rng.randrange(60), t) for i, t in chains(12, 40)]
    rows += [(3, rows[0][1])] * 50 + [(4, None), (4, " "), (3, "")]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components(rows)
    assert len(out) == len(rows)
    assert all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("edits", [2, 9])
def test_hot_group(spark, monkeypatch, edits):
    """Copies of one text, each changed on its own, beside a few far ones: all found, and blocks of one tree don't meet."""
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", 40)
    monkeypatch.setattr(near_dups, "GROUP_BLOCK", 25)
    rng = random.Random(edits)
    page = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(page))]
    for k in range(1, 300):
        words = page[:]
        for _ in range(edits if k % 29 else 30):
            words[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    met = []
    forest = near_dups._forest
    monkeypatch.setattr(near_dups, "_forest", lambda tasks, make, n: met.append(tasks.count()) or forest(tasks, make, n))
    out = near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(rows)
    if edits == 2:  # twelve blocks: each would meet twelve
        assert sum(met[-3:]) < 300 * 5


def test_misses_at_the_threshold():
    for threshold, rows in ((0.85, 6), (0.8, 5)):
        assert near_dups.band_rows(threshold) == rows
        assert (1 - threshold**rows) ** (near_dups.VALUES // rows) <= near_dups.MISSED


def test_five_words_at_four_fifths(spark):
    rows = chains(13, 50)
    out = near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, (80, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(rows, 80, 100, 5)
