"""HTML extraction: the matching against brute force, what induction decides, long and deep pages."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest

from lattica.llm import html


def tree(source):
    return html.Tree(html.skeleton(html.Page(source)))


def brute_weight(a, b):
    """The weight of the best matching, by its definition."""

    @lru_cache(None)
    def nodes(x, y):
        return 1 + lists(x, 0, y, 0) if a.key[x] == b.key[y] else 0

    @lru_cache(None)
    def lists(x, i, y, j):
        one, two = a.children[x], b.children[y]
        if i == len(one) or j == len(two):
            return 0
        w = nodes(one[i], two[j])
        return max(lists(x, i + 1, y, j), lists(x, i, y, j + 1), w + lists(x, i + 1, y, j + 1) if w else 0)

    return nodes(0, 0)


def random_page(rng, depth=4):
    if not depth or rng.random() < 0.2:
        return f"<p>{rng.randrange(5)}</p>"
    return f"<{(t := rng.choice(['div', 'ul', 'section']))}>" + "".join(random_page(rng, depth - 1) for _ in range(rng.randrange(5))) + f"</{t}>"


@pytest.mark.parametrize("cells", [4096, 1, 6])
def test_matching_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html, "TABLE_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(150):
        a, b = tree("".join(random_page(rng) for _ in range(4))), tree("".join(random_page(rng) for _ in range(4)))
        pairs = html.match(a, b)
        assert len(pairs) == brute_weight(a, b) == len(dict(pairs)) == len({y for _, y in pairs})
        up = {c: x for x, own in enumerate(a.children) for c in own}
        over = {c: y for y, own in enumerate(b.children) for c in own}
        of = dict(pairs)
        assert all(a.key[x] == b.key[y] and (x == y == 0 or of[up[x]] == over[y]) for x, y in pairs)
        assert all((x < z) == (of[x] < of[z]) for x in of for z in of)


def test_constant_nodes_are_counted_over_all_pages():
    """A notice on most pages counts by its pages, also where the largest page lacks it."""
    page = "<div><p>text {0}</p>{1}</div>" + "<p>more {0}</p>"
    skeletons = [html.skeleton(html.Page(page.format(k, "" if k in (3, 5) else "<b></b><h6>All on one page</h6>") + ("<p>long</p>" * 9 if k == 3 else ""))) for k in range(12)]
    votes = html.constant_nodes(skeletons)
    assert sorted(votes.values())[-1] == 10


ARTICLE = "<body><div><i>Menu of words</i></div><article><div>Read our paper daily</div><h1>Head {0}</h1><p>First {0}</p><div>Ask for more</div><p>Second {0}</p></article><div>Call us</div></body>"


def test_template_decides_within_articles(spark, monkeypatch):
    """What all pages share goes, in and around an article; without the template nearly every page changes."""
    rows = [(k, f"http://h.example/{k}", ARTICLE.format(k)) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html, "CHUNK_PAGES", 40)
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    want = {k: f"Head {k}\n\nFirst {k}\n\nSecond {k}" for k in range(300)}
    assert got == want
    assert all(html.Page(h).content(set()) != want[k] for k, _, h in rows)
    few = {r["page_id"]: r["text"] for r in html.extract(pages.limit(4)).collect()}
    assert all(t.startswith("Read our paper daily\n\nHead") for t in few.values())


def test_long_and_deep_pages():
    wide = ["".join(f"<div><p>{k} {j}</p>{'<ul><li>x</ul>' if (j + k) % 3 else ''}</div>" for j in range(3000)) for k in range(2)]
    a, b = map(tree, wide)
    assert len(html.match(a, b)) > 0.9 * min(len(a.key), len(b.key))
    deep = "<div>" * 120_000 + "<p>{0}</p><p>same</p>" + "</div>" * 120_000 + "<h2>end {0}</h2>"
    pages = [html.Page(deep.format(k)) for k in range(2)]
    assert max(pages[0].depth) == 120_001
    votes = html.node_votes([html.skeleton(p) for p in pages])
    assert sorted(votes.values()) == [1, 1, 1, 1, 2]
    other = html.Page(deep.format(3).replace("<p>same", "<h3>same"))
    assert len(html.match(html.Tree(html.skeleton(pages[0])), html.Tree(html.skeleton(other)))) == len(pages[0].depth) - 1
