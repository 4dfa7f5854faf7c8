"""The ten operators on small tables: brute force, exact round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest

from lattica.llm import ann, archive, html, language, media, mixing, near_dups, packing, shards, token_counts, tokens
from lattica.session import scratch

DATA = "/root/testdata/sf0.001"
LONG = "thnd onerous " * 20_000
ODD = [
    (1, "the cat sat on the mat, again and again.", "en", "a", 1),
    (2, "the cat sat on the mat, again and again.", "en", "a", 2),
    (2, "the cat sat on the mat, again and again.", "en", "a", 2),
    (3, None, "en", "b", 3),
    (4, "", None, None, 4),
    (5, " \n\t ", "de", "b", 5),
    (6, LONG, "en", "b", 6),
    (7, "one two", "de", "c", 7),
    (8, "ONE TWO", "de", "c", 8),
    (9, "x <|endoftext|> don't  stop　 é́ 1,000.5 \U0001d49c", "fr", "c", 9),
    (None, "lost and found and lost", "fr", "c", None),
    (None, None, None, None, None),
    (10, "123 456 !!", "fr", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, component_id long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", 1, 2.0) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", n_tokens string, copy int, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ODD), key=lambda x: (x is None, x))


def library(name, texts):
    tok = tokens.load_tokenizer(tokens.tokenizer_path(name))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# 1 ------------------------------------------------------------------------------------------


def test_shards(spark, odd, empty):
    out = shards.shuffle_shards(odd, scratch(spark, "t"), shards=3, bucket_bytes=200).collect()
    assert ids(out) == ALL
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(r[0]), str(r[1])) for r in ODD)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == {0, 1, 2}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shards.shuffle_shards(empty, scratch(spark, "t")).count() == 0


def test_shards_are_a_shuffle(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as text")
    out = shards.shuffle_shards(docs, scratch(spark, "t"), shards=4, bucket_bytes=1000).orderBy("shard", "slot").collect()
    order = [r["doc_id"] for r in out]
    assert sorted(order) == list(range(2000))
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1
    again = shards.shuffle_shards(docs, scratch(spark, "t"), shards=4, bucket_bytes=1000).orderBy("shard", "slot").collect()
    assert order == [r["doc_id"] for r in again]


# 2 ------------------------------------------------------------------------------------------


def test_archive(spark, odd, empty):
    folder = scratch(spark, "t")
    files = archive.write_archives(odd, folder, tokens.tokenizer_path("word_bpe_49k.json"), file_bytes=300)
    out = archive.read_archives(files, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x))
    want = {}
    for (i, t, *_), w in zip(ODD, library("word_bpe_49k.json", [r[1] for r in ODD])):
        want.setdefault(i, []).append((len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())))
    got, at = {}, 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    folder = scratch(spark, "t")
    assert archive.read_archives(archive.write_archives(empty, folder, tokens.tokenizer_path("word_bpe_49k.json")), folder).count() == 0


def test_archive_reads_one_document():
    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.read_bytes += len(out)
            return out

    sink = io.BytesIO()
    w = archive.ArchiveWriter(sink)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u2").tobytes() for n in (0, 5, 300_000, 7)]
    for k, d in enumerate(docs):
        w.add(10 * k, d)
    w.close()
    r = archive.ArchiveReader(Counting(sink.getvalue()))
    assert [r.ids(k) for k in range(4)] == docs
    assert r.find(20) == [2] and r.find(21) == []
    Counting.read_bytes = 0
    assert r.ids(3) == docs[3] and Counting.read_bytes < 100
    broken = bytearray(sink.getvalue())
    broken[12] ^= 255
    with pytest.raises(Exception):
        [archive.ArchiveReader(io.BytesIO(bytes(broken))).ids(k) for k in range(4)]


# 3 ------------------------------------------------------------------------------------------


def test_packing(spark, odd, empty):
    out = packing.pack_documents(odd, capacity=64).collect()
    want = library("byte_bpe_50k.json", [r[1] for r in ODD])
    lengths = {}
    for (i, *_), w in zip(ODD, want):
        lengths.setdefault(i, []).append(len(w) + 1)
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {k: sum(v) for k, v in lengths.items()}
    by_id = {r[0]: [*w, 0] for r, w in zip(ODD, want)}
    for r in out:
        if r["doc_id"] is not None:
            part = by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == 64 or r["piece"] == 0
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty).count() == 0


def test_islands_migrate(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 99) for _ in range(1200)]
    rows = [(k, 0, 0, s, 0) for k, s in enumerate(sizes)]
    from lattica.session import materialize

    pieces = materialize(spark.createDataFrame(rows, packing._PIECES))
    out = packing.pack(pieces, capacity=100, island_pieces=300).collect()
    assert ids(out) == list(range(1200))
    whole = packing.Packing(sizes, 100)
    whole.best_fit(sorted(range(1200), key=sizes.__getitem__, reverse=True))
    assert len({r["sequence_id"] for r in out}) <= len(whole.bins) * 1.03 + 4


def test_crossover_keeps_all():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    a, b = packing.Packing(lengths, 100), packing.Packing(lengths, 100)
    a.best_fit(list(range(200)))
    b.best_fit(sorted(range(200), key=lengths.__getitem__, reverse=True))
    child = packing.crossover(a, b, rng)
    assert sorted(p for own in child.bins for p in own) == list(range(200))
    assert all(sum(lengths[p] for p in own) == 100 - left and left >= 0 for own, left in zip(child.bins, child.left))
    best = packing.evolve(lengths, 100, 1)
    assert len(best.bins) <= len(b.bins)


# 4 ------------------------------------------------------------------------------------------


def test_media(spark, odd, empty):
    out = media.read_media(media.store_media(odd)).collect()
    assert ids(out) == ALL
    by = {}
    for r in ODD:
        by.setdefault(r[0], []).append(media.padded(r[1])[0])
    for r in out:
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0
        assert r["payload_sha256"] in {hashlib.sha256(p).hexdigest() for p in by[r["doc_id"]]}
        assert "cc_errors=0;crc_errors=0" in r["feature"]
    same = [r for r in out if r["doc_id"] in (1, 2)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert media.read_media(media.store_media(empty)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 192, 32_704, 32_768, 32_832, 300_032])
def test_transport_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = media.mux(payload)
    s = media.demux(data)
    assert b"".join(s.units) == payload and s.access[0] and s.times == [k * media.UNIT_TICKS for k in range(len(s.times))]
    assert s.programs == {1: media.PMT_PID} and s.streams == {media.ES_PID: media.STREAM_TYPE_PRIVATE}
    lost = data[: 188 * 3] + data[188 * 4 :]
    if len(data) > 188 * 5:
        try:
            assert media.demux(lost).counter_errors > 0
        except ValueError:
            pass


def test_demux_empty():
    assert media.demux(b"").packets == 0
    with pytest.raises(ValueError):
        media.demux(b"\x00" * 188)


# 5 ------------------------------------------------------------------------------------------


def test_token_counts(spark, odd, empty):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    out = token_counts.count_tokens(odd, path).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(w), len(w) > 512) for r, w in zip(ODD, library("byte_bpe_50k.json", [r[1] for r in ODD])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_split_long_is_safe():
    rng = random.Random(7)
    text = "".join(rng.choice("ab c  d\n.,'1é<|endoftext|>") for _ in range(5000)) + " word again " * 50
    parts = token_counts.split_long(text, 100)
    assert "".join(parts) == text and len(parts) > 5
    whole, *split = library("byte_bpe_50k.json", [text, *parts])
    assert whole == [i for p in split for i in p]
    assert token_counts.split_long("x" * 1000, 100) == ["x" * 1000]


@pytest.mark.parametrize("name, dropped", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_word_memo(name, dropped, monkeypatch):
    rng = random.Random(5)
    alphabet = "ab '.,<|>\n\té1Σ́-İß　\x1f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [r[1] for r in ODD]
    monkeypatch.setattr(tokens, "MEMO_WORDS", 200)
    memo = tokens.WordMemo(tokens.tokenizer_path(name), dropped)
    for _ in range(2):
        got = [np.frombuffer(b, "<u2").tolist() for k in range(0, len(texts), 100) for b in memo.encode(texts[k : k + 100])]
        assert got == library(name, texts)


@pytest.mark.parametrize("name, dropped", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_word_memo_composes(name, dropped):
    """Marks that NFC joins to the letter before them aren't cut off from it."""
    marks = [chr(k) for k in range(0x300, 0x370)] + ["\u0338", "\u20d0", "\u0345"]
    words = [stem + mark + sign for stem in ("cafe", "O", "u", "naı", "s", "ü") for mark in marks for sign in ("", ",", "\u2019", "=\u0338", "!\u0301")]
    rng = random.Random(6)
    texts = words + [" ".join(rng.choices(words, k=30)) for _ in range(200)] + ["\u0301 e \u0301e", "e" + "\u0323\u0301", "e\u0301\u0323."]
    texts += [f"word{chr(k)} word{chr(k)}x {chr(k)}" for k in range(0x2010, 0x2028)] + [f"word{chr(k)}\u0301 Word{chr(k)}" for k in range(33, 127)]
    memo = tokens.WordMemo(tokens.tokenizer_path(name), dropped)
    assert [np.frombuffer(b, "<u2").tolist() for b in memo.encode(texts)] == library(name, texts)


# 6 ------------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><div class='top'>Our paper</div><nav><ul><li><a href=/>Home {0}</a></ul></nav>"
    "<article><h1>Head {0}</h1><p><b>First {0} &amp; more<br><p>Second&nbsp; {0}<div class='ad'>Buy {0}</div><div class='comments'><p>I agree {0}</div></article><aside>See {0}</aside><footer>&copy; {0}</footer></body></html>"
)


def test_html(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(k), "z") for k in range(8)]
    rows += [(8, "http://h.example/8", None, "z"), (9, None, "", "z"), (None, "http://x.example", "<p>alone", "z"), (0, "http://h.example/0", PAGE.format(0), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for k in range(8):
        assert got[k] == f"Head {k}\n\nFirst {k} & more\n\nSecond {k}"
    assert got[8] == "" and got[9] == "" and got[None] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.extract(pages.limit(0)).count() == 0


def test_template_is_induced(spark):
    """Without an article element, what all pages of a host share goes; what differs stays."""
    page = "<body><div>Our paper, since 1900</div><div><p>Text {0} of many words</p><p>More {0}</p></div><div>All rights reserved</div></body>"
    pages = spark.createDataFrame([(k, "http://h.example/", page.format(k)) for k in range(9)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got[4] == "Text 4 of many words\n\nMore 4"


def test_tree_matching():
    a = html.Tree(html.skeleton(html.Page("<div><p>a<p>b<ul><li>1<li>2</ul></div><p>z")))
    b = html.Tree(html.skeleton(html.Page("<div><p>a<ul><li>1<li>2<li>3</ul></div><h2>n</h2><p>z")))
    assert len(html.match(a, b)) == 7
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    s = html.skeleton(html.Page(deep))
    assert html.constant_nodes([s, html.skeleton(html.Page(deep.replace("x", "y")))]) == {}


# 7 ------------------------------------------------------------------------------------------


def shingle_set(text, n=3):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, above=85, below=100, words=3):
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    of = {i: i for i, _ in sets if i is not None}
    changed = True
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and i is not None and j is not None and below * len(a & b) >= above * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            low = min(of[i], of[j])
            if of[i] != low or of[j] != low:
                of[i] = of[j] = low
                changed = True
    return of


def test_near_duplicates_odd(spark, odd, empty):
    out = near_dups.near_duplicates(odd).collect()
    assert ids(out) == ALL
    want = brute_components([(r[0], r[1]) for r in ODD])
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert near_dups.near_duplicates(empty).count() == 0


def chains(seed=11, n=60):
    """Texts in chains whose neighbours are just above or below the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, k = [], 0
    for _ in range(n):
        text = [word() for _ in range(rng.choice([3, 8, 40, 90]))]
        for _ in range(rng.randint(1, 6)):
            rows.append((k, " ".join(text)))
            k += 1
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    return rows


@pytest.mark.parametrize("blocks", [(2048, 512), (4, 3)])
def test_near_duplicates_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dups, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(near_dups, "GROUP_BLOCK", blocks[1])
    rows = chains()
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {i: len(shingle_set(t)) for i, t in rows}


# 8 ------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 20)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(700, None, 1), (720, [0.0] * 20, 1), (740, [None] * 20, 1), (760, [float("nan")] * 20, 1), (780, [1.0] * 3, 1), (None, [1.0] * 20, 1), (800, [float("inf")] * 20, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = ann.search(df, df["vec_id"] % 20 == 0).collect()
    assert {r["query_id"] for r in out} == set(range(0, 600, 20))
    y = x.astype(float)
    hit = 0
    for q in range(0, 600, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 21))
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:20]
        hit += len(set(best.tolist()) & {v for _, v, _ in own})
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in own)
    assert hit / (30 * 20) >= 0.9
    assert ann.search(df.limit(0), df["vec_id"] % 20 == 0).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, rank int")
    assert ann.search(few, few["vec_id"] % 20 == 0).count() == 3
    one = spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>, rank int")
    assert ann.search(one, one["vec_id"] % 20 == 0).count() == 0


def test_multi_index_is_exact():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[:, 1:] &= 7
    index = ann.MultiIndex(codes)
    for r in (0, 3, 9, 20, 40):
        want = np.flatnonzero(ann._POP[codes ^ codes[7]].sum(axis=1, dtype=int) <= r)
        assert index.within(codes[7], r).tolist() == want.tolist()


# 9 ------------------------------------------------------------------------------------------


def test_mixing(spark, odd, empty):
    out = mixing.mix(odd)
    assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == [c for c in odd.columns if c != "copy"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ODD}
    keys = [r["shuffle_key"] for r in mixing.mix(odd).coalesce(1).sortWithinPartitions("shuffle_key").collect()]
    assert sorted(keys) == sorted(r["shuffle_key"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_reaches_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('x', 99) as text", "case when id % 6 < 4 then 'a' when id % 6 = 4 then 'b' end as source")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, {"a": 1, "b": 1, None: 2}).collect()}
    assert rates == {"a": pytest.approx(0.375), "b": pytest.approx(1.5), None: pytest.approx(3.0)}
    n = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 1, "b": 1, None: 2}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(1500, rel=0.1) and n["b"] == pytest.approx(1500, rel=0.1) and n[None] == pytest.approx(3000, rel=0.1)
    many = mixing.mix(docs, {"b": 1}, size=1.0).groupBy("source", "doc_id").count().collect()
    counts = np.array([r["count"] for r in many])
    assert {r["source"] for r in many} == {"b"} and counts.sum() == pytest.approx(6000, rel=0.06)


def test_mixing_without_ids_is_the_sql(spark, tmp_path, monkeypatch):
    """Null, repeated and unique ids, equal rows and null sources: as the SQL says, near the rate, over all partitions."""
    import duckdb

    from lattica.llm import rows as rows_

    monkeypatch.setattr(rows_, "REPEAT_BLOCK", 700)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 and k < 300 else k, None if k % 5 == 0 else "same" if k % 2 else f"text é {k}", "en", "ab"[k % 2] if k % 7 else None, None if k % 3 == 0 else 4) for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op9_source_mixing(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute("SELECT doc_id, source, copy, n_bytes, shuffle_key FROM (" + mixing.OP9_SQL + ")").fetchall()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["source"], r["copy"], r["n_bytes"], r["shuffle_key"])) for r in got)
    mixed = mixing.mix(docs.withColumn("source", docs["lang"]))
    assert mixed.filter("doc_id is null").count() == pytest.approx(3000, rel=0.1)
    spread = [r["count"] for r in mixed.filter("doc_id is null").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(spread) == 4 and min(spread) > 0.5 * max(spread)


# 10 -----------------------------------------------------------------------------------------


def test_language_odd(spark, odd, empty):
    out = language.identify(odd).collect()
    assert ids(out) == ALL
    for r in out:
        assert 0.0 <= r["score"] <= 1.0
        if r["doc_id"] in (3, 4, 5, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.identify(empty).count() == 0
    none = language.predict(odd, {}).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_brute_force():
    """Bundles are the sums of bound and rotated letter vectors."""
    g = language.Trigrams(64, 1)
    got = g.bundles(["Ab, ba!"])[0]
    want = np.zeros(64)
    c = [0, ord("a"), ord("b"), 0, ord("b"), ord("a"), 0]
    for x, y, z in zip(c, c[1:], c[2:]):
        want += np.roll(g._letter(x), 2).astype(int) * np.roll(g._letter(y), 1) * g._letter(z)
    assert got.tolist() == want.tolist()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_language_held_out(spark):
    from pyspark.sql import functions as F

    sf = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.op10_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_pieces_and_memory(monkeypatch):
    """Counts don't depend on how a text is cut, nor sums on how texts are; short texts in a large alphabet stay small."""
    import tracemalloc

    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é1 .ßǅ\U0001d49cx") for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)]
    g = language.Trigrams(32, 1)
    counts, sums = [g.counts(t) for t in texts], g.bundles(texts)
    monkeypatch.setattr(language, "PIECE_CHARS", 3)
    monkeypatch.setattr(language, "BOUND_TRIGRAMS", 5)
    monkeypatch.setattr(language, "COUNT_CELLS", 20)
    for t, (k, n) in zip(texts, counts):
        keys, times = g.counts(t)
        assert keys.tolist() == k.tolist() and times.tolist() == n.tolist()
    assert (g.bundles(texts) == sums).all()
    monkeypatch.undo()
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(17)) for _ in range(10_000)]
    g = language.Trigrams()
    tracemalloc.start()
    g.bundles(han)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30


def test_shards_scatter_equal_rows(spark):
    docs = spark.createDataFrame([(5, "same row")] * 3000 + [(None, "same row")] * 3000 + [(None, None)] * 2000, "doc_id long, text string")
    out = shards.shuffle_shards(docs, scratch(spark, "t"), bucket_bytes=4000).groupBy("doc_id", "text", "bucket").count().collect()
    for key in {(r["doc_id"], r["text"]) for r in out}:
        n = [r["count"] for r in out if (r["doc_id"], r["text"]) == key]
        assert sum(n) in (3000, 2000) and max(n) < 3 * sum(n) / len(n) and len(n) > 10


def test_archive_keeps_the_least_id(spark):
    docs = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (3, None)], "doc_id long, text string")
    folder = scratch(spark, "t")
    out = archive.read_archives(archive.write_archives(docs, folder, tokens.tokenizer_path("word_bpe_49k.json")), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, -(2**63), 3]
