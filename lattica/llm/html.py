"""Operator 6, HTML extraction: wrapper induction by simple tree matching.

Pages of a host are aligned as trees of block elements. Nodes that match and
hold the same text on nearly all of a host's differing pages are constant: they
are the host's template, also within an article. Varying slots are content,
unless the element says that it is something else (menus, asides, forms, adverts,
comments and so on): those vary from page to page too, so their text can't tell.
Hosts of too few pages to induce a wrapper go by the mark of the article.

Alignment runs on skeletons (a few bytes a node) in chunks of a bounded number
of a host's pages, and the chunks' votes are summed, so that a host with a third
of all pages is spread over many tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.tokens import by_bytes
from lattica.session import materialize, table

#: Pages aligned with one seed page, on average.
CHUNK_PAGES = 128
#: A node is template if it has the same text on this share of at least so many differing pages of its host.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 5
#: Rows of the template table up to which it's broadcast (one is about 100 bytes); beyond, a salted join.
BROADCAST_ROWS, SALTS = 100_000, 64
#: Cells of the matching table of two child lists that is held whole; larger ones are halved until they fit.
TABLE_CELLS = 4_096
BATCH_BYTES = 2 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold the article's text.
BOILERPLATE = frozenset("nav footer aside form script style noscript iframe button select option textarea template svg canvas object dialog menu head title xmp audio video".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu menubar toolbar".split())
#: Words of classes and ids that mark other matter; compared whole, split at - and _ and letter case.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " comment comments commentlist disqus reply replies respond menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer footnav masthead topbar"
    " toolbar share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip tracking teaser".split()
)
#: First words of classes that describe what an element has around it, not what it is.
STATES = frozenset("has with no is without".split())
_TAG = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What an opening tag closes, up to the element named after the colon.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(text)}


def _marked(attrs: dict[str, str]) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if words and words[0] not in STATES and not MARKS.isdisjoint(words):
            return True
    return False


class Page:
    """Block elements of a page in order: depth, key, path, whether boilerplate, whether in an article; and its blocks of text."""

    __slots__ = ("blocks", "boiler", "depth", "key", "main", "path")

    def __init__(self, source: str):
        self.depth, self.key, self.path, self.boiler, self.main = [0], [0], [0], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]  # open elements; inline ones share their block's node
        opened: dict[str, int] = {}
        parts: list[str] = []
        at, size = 0, len(source)

        def open_(tag: str, node: int) -> None:
            stack.append((tag, node))
            opened[tag] = opened.get(tag, 0) + 1

        def close(k: int) -> None:
            """Ends the elements from place k on."""
            for tag, _ in stack[k:]:
                opened[tag] -= 1
            del stack[k:]

        def flush() -> None:
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1][1], text))

        while at < size:
            m = _TAG.search(source, at)
            if not m:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0] == "<!--":
                    end = source.find("-->", at)
                    at = size if end < 0 else end + 3
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    parts.append(" ")
                elif opened.get(tag):
                    if tag in INLINE:
                        k = len(stack) - 1
                        while stack[k][0] != tag and stack[k][0] in INLINE:
                            k -= 1
                        if stack[k][0] == tag:
                            opened[tag] -= 1
                            del stack[k]
                        continue
                    flush()
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
                elif tag not in INLINE:
                    flush()
                continue
            if tag in INLINE:
                if tag == "br":
                    parts.append(" ")
                elif tag not in VOID:
                    attrs = _attributes(m[3]) if m[3] else {}
                    if attrs and _marked(attrs):  # an inline element that is other matter stands as a node of its own
                        flush()
                        open_(tag, self._node(stack[-1][1], tag, attrs))
                    else:
                        open_(tag, stack[-1][1])
                continue
            flush()
            if tag in _CLOSES:
                closes, scope = _CLOSES[tag]
                if any(opened.get(t) for t in closes):
                    k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in closes or stack[k][0] in scope)
                    if stack[k][0] in closes:
                        close(k)
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), 0)
            if stack[k][0] == "p":  # a block ends a paragraph
                close(k)
            while len(stack) > 1 and stack[-1][0] in INLINE:  # inline elements don't reach into blocks
                close(len(stack) - 1)
            if tag in VOID:
                continue
            node = self._node(stack[-1][1], tag, _attributes(m[3]) if m[3] else {})
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(source, at)
                raw = source[at : end.start() if end else size]
                if raw.strip():
                    self.blocks.append((node, " ".join(raw.split())))
                past = source.find(">", end.start()) if end else -1
                at = size if past < 0 else past + 1
                continue
            open_(tag, node)
        flush()

    def _node(self, parent: int, tag: str, attrs: dict[str, str]) -> int:
        key = crc32(f"{tag}.{attrs.get('class', '')}#{re.sub(r'[0-9]+', '0', attrs.get('id', ''))}".encode())
        other = tag in BOILERPLATE or (_marked(attrs) if attrs and tag not in ("html", "body") else False)
        own = not other and (tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article"))
        if tag == "header" and not self.main[parent]:
            other = True
        self.depth.append(self.depth[parent] + 1)
        self.key.append(key)
        self.path.append(crc32(b"%d/%d" % (self.path[parent], key)))
        self.boiler.append(self.boiler[parent] or other)
        self.main.append(self.main[parent] or own)
        return len(self.depth) - 1

    def texts(self) -> list[int]:
        """A hash of each node's own text; 0 where it has none."""
        out = [0] * len(self.depth)
        for node, text in self.blocks:
            out[node] = crc32(text.encode(), out[node]) or 1
        return out

    def content(self, template: set[tuple[int, int]] | None) -> str:
        """The main text: blocks that are neither boilerplate nor template. Without a wrapper (None), of the article where one is marked."""
        own = self.texts() if template else []
        kept = [n for n, _ in self.blocks if not self.boiler[n]]
        marked = template is None and any(self.main[n] for n in kept)
        return "\n\n".join(t for n, t in self.blocks if not self.boiler[n] and (self.main[n] or not marked) and not (template and (self.path[n], own[n]) in template))


_NODE = np.dtype([("depth", "<u4"), ("key", "<u4"), ("path", "<u4"), ("text", "<u4")])


def skeleton(page: Page) -> bytes:
    out = np.zeros(len(page.depth), _NODE)
    out["depth"], out["key"], out["path"], out["text"] = page.depth, page.key, page.path, page.texts()
    return out.tobytes()


class Tree:
    """A skeleton as a tree, with a hash of each subtree's elements."""

    def __init__(self, data: bytes):
        a = np.frombuffer(data, _NODE)
        self.key, self.path, self.text = a["key"].tolist(), a["path"].tolist(), a["text"].tolist()
        depth = a["depth"].tolist()
        self.children: list[list[int]] = [[] for _ in depth]
        trail: list[int] = []
        for k, d in enumerate(depth):
            del trail[d:]
            if trail:
                self.children[trail[-1]].append(k)
            trail.append(k)
        self.form = self.key[:]
        self.size = [1] * len(depth)
        for k in range(len(depth) - 1, -1, -1):
            if self.children[k]:
                self.form[k] = hash((self.key[k], *(self.form[c] for c in self.children[k])))
                self.size[k] += sum(self.size[c] for c in self.children[k])


def _table(weights: list[list[int]]) -> list[tuple[int, int]]:
    """Places of a heaviest matching of two lists that keeps their order."""
    n, m = len(weights), len(weights[0])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i, own in enumerate(weights):
        row, above = best[i + 1], best[i]
        for j, w in enumerate(own):
            top = above[j + 1]
            if row[j] > top:
                top = row[j]
            if w and above[j] + w > top:
                top = above[j] + w
            row[j + 1] = top
    out = []
    i, j = n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def _heaviest(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """As `_table` for weight[rows][:, columns], in memory that grows with the lists: halves of `rows` and the best cut of `columns`."""
    out = []
    parts = [(0, len(rows), 0, len(columns))]
    while parts:
        a, b, c, d = parts.pop()
        if a == b or c == d:
            continue
        if b - a == 1 or (b - a) * (d - c) <= TABLE_CELLS:
            if b - a == 1:
                own = weight[rows[a], columns[c:d]]
                if own.max():
                    out.append((a, c + int(own.argmax())))
            else:
                out += [(a + i, c + j) for i, j in _table(weight[np.ix_(rows[a:b], columns[c:d])].tolist())]
            continue
        mid = (a + b) // 2
        up, down = np.zeros(d - c + 1, np.int64), np.zeros(d - c + 1, np.int64)
        for i in range(a, mid):
            up[1:] = np.maximum.accumulate(np.maximum(up[1:], up[:-1] + weight[rows[i], columns[c:d]]))
        for i in range(b - 1, mid - 1, -1):
            down[1:] = np.maximum.accumulate(np.maximum(down[1:], down[:-1] + weight[rows[i], columns[c:d][::-1]]))
        cut = c + int((up + down[::-1]).argmax())
        parts += [(a, mid, c, cut), (mid, b, cut, d)]
    return out


class Matching:
    """Simple tree matching of one tree with others: children are matched in order, each pair by the best matching of its subtrees.

    What two subtrees give depends on their elements alone, so it is kept by
    the pair of their forms. No recursion: pages nest as deep as they like.
    """

    def __init__(self):
        self.weight: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int, list[tuple[int, int]]]] = {}

    def _ends(self, a: Tree, b: Tree, x: int, y: int) -> tuple[int, int]:
        """How many equal children at either end match each other; they do in a best matching."""
        one, two = a.children[x], b.children[y]
        most, n, m = min(len(one), len(two)), 0, 0
        while n < most and a.form[one[n]] == b.form[two[n]]:
            n += 1
        while m < most - n and a.form[one[-1 - m]] == b.form[two[-1 - m]]:
            m += 1
        return n, m

    def _solve(self, a: Tree, b: Tree, x: int, y: int) -> None:
        stack = [(x, y)]
        while stack:
            x, y = stack[-1]
            at = (a.form[x], b.form[y])
            if at in self.weight:
                stack.pop()
                continue
            n, m = self._ends(a, b, x, y)
            one, two = a.children[x], b.children[y]
            rows, columns = one[n : len(one) - m], two[n : len(two) - m]
            forms, others = {}, {}  # a node for each form
            for c in rows:
                forms.setdefault(a.form[c], c)
            for d in columns:
                others.setdefault(b.form[d], d)
            missing, table = [], np.zeros((len(forms), len(others)), np.int64)
            for i, c in enumerate(forms.values()):
                for j, d in enumerate(others.values()):
                    if a.key[c] != b.key[d]:
                        continue
                    if a.form[c] == b.form[d]:
                        table[i, j] = a.size[c]
                    elif not a.children[c] or not b.children[d]:
                        table[i, j] = 1
                    elif (w := self.weight.get((a.form[c], b.form[d]))) is None:
                        missing.append((c, d))
                    else:
                        table[i, j] = w
            if missing:
                stack += missing
                continue
            found = []
            if rows and columns:
                place, other = {f: k for k, f in enumerate(forms)}, {f: k for k, f in enumerate(others)}
                i, j = np.array([place[a.form[c]] for c in rows]), np.array([other[b.form[d]] for d in columns])
                found = _heaviest(i, j, table)
                total = sum(int(table[i[p], j[q]]) for p, q in found)
            else:
                total = 0
            total += 1 + sum(a.size[c] for c in [*one[:n], *one[len(one) - m :]])
            self.weight[at], self.pairs[at] = total, (n, m, found)
            stack.pop()

    def match(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """The largest set of pairs of nodes that keeps roots, order and ancestry."""
        out, stack = [], [(0, 0)] if a.key[0] == b.key[0] else []
        while stack:
            x, y = stack.pop()
            if a.form[x] == b.form[y]:
                out += zip(range(x, x + a.size[x]), range(y, y + b.size[y]))
                continue
            out.append((x, y))
            one, two = a.children[x], b.children[y]
            if not one or not two:
                continue
            self._solve(a, b, x, y)
            n, m, found = self.pairs[a.form[x], b.form[y]]
            stack += zip(one[:n], two[:n])
            stack += zip(one[len(one) - m :], two[len(two) - m :])
            stack += [(one[n + p], two[n + q]) for p, q in found]
        return out


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching of two trees."""
    return Matching().match(a, b)


def constant_nodes(skeletons: list[bytes]) -> dict[tuple[int, int], int]:
    """(path, text) of nodes whose text two pages at least share, and on how many pages."""
    return {at: n for at, n in node_votes(skeletons).items() if n > 1}


def node_votes(skeletons: list[bytes]) -> dict[tuple[int, int], int]:
    """(path, text) of nodes with text, and on how many pages.

    What half of the pages hold is counted by alignment, with a page that holds
    it: the largest one, and further ones until each such node is on one. What
    fewer hold counts wherever it stands.
    """
    trees = sorted((Tree(s) for s in skeletons), key=lambda t: (-len(t.key), t.text))
    held = [{(p, t) for p, t in zip(tree.path, tree.text) if t} for tree in trees]
    votes: dict[tuple[int, int], int] = {}
    for own in held:
        for at in own:
            votes[at] = votes.get(at, 0) + 1
    frequent = {at for at, n in votes.items() if n > 1 and 2 * n >= len(trees)}
    votes = {at: n for at, n in votes.items() if at not in frequent}
    for seed, own in zip(trees, held):
        left = frequent & own
        if not left:
            continue
        frequent -= left
        matching, on = Matching(), dict.fromkeys(left, 0)
        for tree in trees:
            pairs = zip(range(len(seed.key)), range(len(seed.key))) if tree is seed else matching.match(seed, tree)
            same = {(seed.path[x], seed.text[x]) for x, y in pairs if seed.text[x] and seed.text[x] == tree.text[y]}
            for at in same & left:
                on[at] += 1
        votes |= on
    return votes


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def induce(pages: DataFrame) -> DataFrame:
    """Templates of hosts, from all rows of pages (url, html): host, path, text and the pages that vote for it.

    Each host with TEMPLATE_PAGES differing pages also has a row without path and text.
    """

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([skeleton(Page(h)) for h in batch.column("html").to_pylist()], pa.binary())], ["host", "nodes"])

    found = pages.filter("html is not null").select(_host(F.col("url")).alias("host"), "html").mapInArrow(skeletons, "host string, nodes binary")
    # copies of a page count once: they vote for nothing, and none of their number meets in one task
    differing = materialize(found.groupBy("host", F.xxhash64("nodes").alias("digest")).agg(F.first("nodes").alias("nodes")), "skeletons")
    hosts = differing.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= TEMPLATE_PAGES)
    chunk = F.pmod(F.col("digest"), F.ceil(F.col("pages") / CHUNK_PAGES)).cast("int").alias("chunk")
    # a host's chunks are dealt anew: they would stay together where the join has dealt them by host
    dealt = differing.join(hosts, "host").select("host", "pages", chunk, "nodes").repartition("host", "chunk")

    def vote(pdf):
        kept = [(p, t, n) for (p, t), n in node_votes([bytes(n) for n in pdf["nodes"]]).items()]
        out = pdf.iloc[:1][["host", "pages"]].loc[[pdf.index[0]] * len(kept)].reset_index(drop=True)
        for k, name in enumerate(("path", "text", "votes")):
            out[name] = [v[k] for v in kept]
        return out[["host", "path", "text", "votes", "pages"]]

    votes = dealt.groupBy("host", "chunk").applyInPandas(vote, "host string, path long, text long, votes long, pages long")
    summed = votes.groupBy("host", "path", "text").agg(F.sum("votes").alias("votes"), F.max("pages").alias("pages"))
    constant = summed.filter(F.col("votes") >= TEMPLATE_SHARE * F.col("pages")).select("host", "path", "text", "votes")
    # a host without constant nodes has a wrapper too
    return constant.unionByName(hosts.select("host", F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("text"), F.col("pages").alias("votes")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html).

    Null html, and pages without main text, give an empty text. Null ids, null
    urls (a host of their own) and repeated rows stay; an empty table gives none;
    other columns are left behind. Hosts with fewer than TEMPLATE_PAGES differing
    pages have no wrapper. Of equally heavy matchings of two pages any may count;
    which is the same in every run.
    """
    templates = materialize(induce(pages), "templates")
    by_host = templates.groupBy("host").agg(F.collect_list(F.struct("path", "text")).alias("template"))
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    if templates.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(by_host), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        spread = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(spread, ["host", "salt"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES, "html"):
            out = []
            for source, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                out.append(Page(source).content(None if template is None else {(t["path"], t["text"]) for t in template}) if source else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "template").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
