"""The pipeline on the smallest tables against a plain version, and its stages on odd rows."""

from __future__ import annotations

import os

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402

from lattica.llm import language, mixing, tokens  # noqa: E402
from tests.llm.test_operators import DATA, ODD, SCHEMA, brute_components  # noqa: E402


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for rows in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, rows, "").columns == docs.columns
    kept = {r["doc_id"] for r in P.language_id(spark, docs, "").collect()}
    assert 3 not in kept and 5 not in kept and {1, 2, 6} <= kept
    kept = sorted(r["doc_id"] for r in P.near_dups(spark, docs, "").collect() if r["doc_id"] is not None)
    assert 1 in kept and 2 not in kept and 7 in kept and 8 not in kept


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_run_is_the_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    best = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    rows = [r for r in rows if best[r[0]][0] != "und" and best[r[0]][1] >= P.LEAST_SCORE]
    of = brute_components([r[:2] for r in rows], 80, 100, 5)
    rows = [r for r in rows if of[r[0]] == r[0]]
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {}
    for r in mixing.mix(left).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    tok = tokens.load_tokenizer(tokens.tokenizer_path("byte_bpe_50k.json"))
    want = {i: copies[i] * (len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows if i in copies}
    out = P.run(spark, DATA).collect()
    got, fill = {}, {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert got == want
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(want.values()) // 2048) + 3


def test_packing_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD] * 2, SCHEMA + ", length string, offset int")
    out = P.packing(spark, docs, "").collect()
    tok = tokens.load_tokenizer(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in out) == 2 * sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    assert P.packing(spark, docs.limit(0), "").count() == 0


def test_null_and_repeated_ids_stay_apart(spark):
    """Rows without an id are judged each on its own by every stage."""
    words = lambda k: " ".join(f"the weather of day {k} was {w} again" for w in ("fair", "wet", "cold", "mild"))
    rows = [(None, words(k) if k % 2 else "123 ?!", "en", "a") for k in range(2000)] + [(7, "456", "en", "a"), (7, words("seven"), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = P.language_id(spark, docs, "")
    assert kept.filter("doc_id is null").count() == 1000 and kept.filter("doc_id = 7").count() == 1
    assert P.near_dups(spark, kept, "").filter("doc_id is null").count() == 1000
    assert P.mixing(spark, kept, "").filter("doc_id is null").count() == pytest.approx(1000, rel=0.15)
