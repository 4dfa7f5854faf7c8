"""Queries over derived graphs, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import orbits as O
from lattica.operators import scoring as S
from lattica.operators import selectors as B
from lattica.operators.components import connected_components
from lattica.operators.edge_masks import endpoint_delta, mask_histogram
from lattica.session import materialize, table
from lattica.sources.graphs import QUANTITY, load_graph, ring, star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, without a negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _graph_sql(name: str) -> str:
    return f"""li AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= {QUANTITY[name]}),
e AS (SELECT DISTINCT a.p AS u, b.p AS v FROM li a JOIN li b ON a.o = b.o AND a.p < b.p),
n AS (SELECT p_partkey AS node, p_brand AS label FROM part),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
d AS (SELECT node, count(b.u) AS degree FROM n LEFT JOIN b ON n.node = b.u GROUP BY node)"""


_G, _GS = _graph_sql("gp"), _graph_sql("gs")
_SUP = """,
cn AS (SELECT x.u AS u, y.u AS v, count(*) AS c FROM b x JOIN b y ON x.v = y.v AND x.u < y.u GROUP BY ALL),
sup AS (SELECT e.u, e.v, coalesce(cn.c, 0) AS support FROM e LEFT JOIN cn ON e.u = cn.u AND e.v = cn.v)"""
_MASKS = ", ".join(str(m) for m in O.masks())
_GRAPHLETS = """,
t3 AS (SELECT DISTINCT list_sort([x.u, x.v, y.v]) AS n FROM b x JOIN b y ON x.u = y.u AND x.v < y.v),
q4 AS (SELECT DISTINCT list_sort(list_append(t.n, b.v)) AS n FROM (SELECT n, unnest(n) AS m FROM t3) t JOIN b ON b.u = t.m AND NOT list_contains(t.n, b.v)),
s AS (SELECT n FROM t3 UNION ALL SELECT n FROM q4 UNION ALL SELECT [u, v] FROM e),
pr(i, j, bit) AS (VALUES (1, 2, 1), (1, 3, 2), (1, 4, 4), (2, 3, 8), (2, 4, 16), (3, 4, 32)),
g AS (SELECT s.n, len(s.n)::INT AS size, sum(pr.bit)::INT AS mask FROM s JOIN pr ON pr.j <= len(s.n) JOIN e ON e.u = s.n[pr.i] AND e.v = s.n[pr.j] GROUP BY s.n),
mk(size, mask, place, orbit) AS (VALUES """ + _MASKS + """),
gl AS (SELECT nn.node, o.orbit, coalesce(c.cnt, 0) AS cnt FROM n nn CROSS JOIN (SELECT unnest(range(0, 15))::INT AS orbit) o
  LEFT JOIN (SELECT g.n[mk.place + 1] AS node, mk.orbit, count(*) AS cnt FROM g JOIN mk USING (size, mask) GROUP BY ALL) c ON c.node = nn.node AND c.orbit = o.orbit),
st AS (SELECT orbit, avg(ln(1.0 + cnt)) AS mu, CASE WHEN stddev_pop(ln(1.0 + cnt)) < 1e-12 THEN 1.0 ELSE stddev_pop(ln(1.0 + cnt)) END AS sd FROM gl GROUP BY orbit)"""
_WIDE = ", ".join(f"sum(CASE WHEN orbit = {k} THEN cnt ELSE 0 END)::BIGINT AS o{k}" for k in range(15))
_MOVES = """,
hit AS (SELECT g.n, g.size, g.mask, g.n[pr.i] AS u, g.n[pr.j] AS v, g.mask - pr.bit AS rest FROM g JOIN pr ON (g.mask & pr.bit) <> 0),
mv AS (SELECT h.u, h.v, h.n[a.place + 1] AS node, a.orbit AS src, coalesce(z.orbit, 15) AS dst FROM hit h JOIN mk a ON a.size = h.size AND a.mask = h.mask
  LEFT JOIN mk z ON z.size = h.size AND z.mask = h.rest AND z.place = a.place),
de AS (SELECT u, v, node, orbit, sum(x)::BIGINT AS delta FROM (SELECT u, v, node, src AS orbit, -1 AS x FROM mv UNION ALL SELECT u, v, node, dst, 1 FROM mv WHERE dst < 15) GROUP BY ALL HAVING sum(x) <> 0)"""


def _score_sql(weight: str = "1.0") -> str:
    return f"""{_MOVES},
z AS (SELECT gl.node, gl.orbit, gl.cnt, (ln(1.0 + gl.cnt) - mu) / sd AS z, mu, sd, {weight} AS w FROM gl JOIN st USING (orbit)),
dn AS (SELECT node, 1e-8 + sum(w * abs(z)) AS denom FROM z GROUP BY node),
sh AS (SELECT de.u, de.v, de.node, sum(w * abs(z.z - (ln(1.0 + greatest(z.cnt + de.delta, 0)) - z.mu) / z.sd)) AS shift FROM de JOIN z USING (node, orbit) WHERE de.node IN (de.u, de.v) GROUP BY ALL),
sc AS (SELECT e.u, e.v, avg(coalesce(sh.shift, 0)) AS mean_abs, avg(coalesce(sh.shift, 0) / dn.denom) AS mean_rel, avg(dn.denom) AS mean_denom, min(dn.denom) AS min_denom
  FROM (SELECT u, v, u AS node FROM e UNION ALL SELECT u, v, v FROM e) e JOIN dn USING (node) LEFT JOIN sh ON sh.u = e.u AND sh.v = e.v AND sh.node = e.node GROUP BY e.u, e.v)"""


def _gp(spark, sf_dir):
    return load_graph(spark, sf_dir, "gp")


@query(f"WITH {_G} SELECT node, label FROM n")
def S01_load_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gp(spark, sf_dir)[0]


@query(f"WITH {_G} SELECT u, v FROM e")
def P01_canonical_edges(spark, sf_dir):
    return _gp(spark, sf_dir)[1]


@query(f"WITH {_G} SELECT u, v FROM b")
def P02_bidirectional(spark, sf_dir):
    return G.bidirectional(_gp(spark, sf_dir)[1])


@query(f"WITH {_G} SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM e")
def P03_edge_ids(spark, sf_dir):
    return G.edge_ids(_gp(spark, sf_dir)[1])


@query(f"WITH {_G} SELECT node, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_ptr, degree FROM d")
def P03_csr(spark, sf_dir):
    return G.csr(*_gp(spark, sf_dir)).drop("col_idx")


@query(f"WITH {_G}, k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM n WHERE node % 3 = 0) SELECT a.i AS u, c.i AS v FROM e JOIN k a ON a.node = e.u JOIN k c ON c.node = e.v")
def P04_induced_subgraph(spark, sf_dir):
    nodes, edges = _gp(spark, sf_dir)
    return G.induced(nodes.filter("node % 3 = 0"), edges)


@query(f"WITH {_G} SELECT u, v FROM e WHERE (u + v) % 5 <> 0")
def P05_remove_edges(spark, sf_dir):
    edges = _gp(spark, sf_dir)[1]
    return G.remove_edges(edges, edges.filter("(u + v) % 5 = 0").select(F.col("v").alias("u"), F.col("u").alias("v")))


#: The 15 orbits as published: (orbit, size, edges, nodes of the orbit in its graphlet, their degree in it).
_ORBITS = """(0, 2, 1, 2, 1), (1, 3, 2, 2, 1), (2, 3, 2, 1, 2), (3, 3, 3, 3, 2), (4, 4, 3, 2, 1), (5, 4, 3, 2, 2), (6, 4, 3, 3, 1), (7, 4, 3, 1, 3),
(8, 4, 4, 4, 2), (9, 4, 4, 1, 1), (10, 4, 4, 2, 2), (11, 4, 4, 1, 3), (12, 4, 5, 2, 2), (13, 4, 5, 2, 3), (14, 4, 6, 4, 3)"""


@query(f"SELECT orbit, size, edges, multiplicity, role_degree FROM (VALUES {_ORBITS}) t(orbit, size, edges, multiplicity, role_degree)")
def P11_orbit_registry(spark, sf_dir):
    return spark.createDataFrame(O.registry(), "orbit int, size int, edges int, multiplicity int, role_degree int")


@query(f"WITH {_G} SELECT u AS node, array_to_string(list_sort(list(v)), ',') AS neighbours FROM b GROUP BY u")
def G01_adjacency(spark, sf_dir):
    a = G.adjacency(_gp(spark, sf_dir)[1])
    return a.select("node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"WITH {_G} SELECT node, degree FROM d")
def G02_degree(spark, sf_dir):
    return G.degrees(*_gp(spark, sf_dir))


@query(f"WITH {_G}{_SUP} SELECT u, v, support::BIGINT AS support FROM sup")
def G03_triangle_support(spark, sf_dir):
    return G.support(_gp(spark, sf_dir)[1])


@query(f"""WITH {_G}, s0 AS (SELECT node FROM n WHERE node % 50 = 0), s1 AS (SELECT node FROM s0 UNION SELECT b.v FROM s0 JOIN b ON b.u = s0.node)
SELECT node FROM s1 UNION SELECT b.v FROM s1 JOIN b ON b.u = s1.node""")
def G04_two_hop(spark, sf_dir):
    nodes, edges = _gp(spark, sf_dir)
    return G.k_hop(edges, nodes.filter("node % 50 = 0"), 2)


_REACH = "r AS (SELECT node AS a, node AS c FROM n UNION SELECT r.a, b.v FROM r JOIN b ON r.c = b.u)"


@query(f"""WITH RECURSIVE {_GS}, {_REACH}, z AS (SELECT u, v FROM e),
w AS (SELECT z.u, z.v, z.u AS c FROM z UNION SELECT w.u, w.v, b.v FROM w JOIN b ON w.c = b.u AND NOT (least(b.u, b.v) = w.u AND greatest(b.u, b.v) = w.v))
SELECT u, v FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.u = e.u AND w.v = e.v AND w.c = e.v)""")
def G05_bridges(spark, sf_dir):
    return G.bridges(load_graph(spark, sf_dir, "gs")[1])


@query(f"WITH RECURSIVE {_GS}, {_REACH} SELECT a AS node, min(c) AS component FROM r GROUP BY a")
def G07_components(spark, sf_dir):
    nodes, edges = load_graph(spark, sf_dir, "gs")
    c = connected_components(edges)
    return nodes.select("node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query(f"""WITH RECURSIVE {_GS}, {_REACH}, c AS (SELECT a, min(c) AS l FROM r GROUP BY a), k AS (SELECT l, count(*) AS m FROM c GROUP BY l)
SELECT count(*) AS components, round(max(m) / sum(m), 6) AS largest_ratio FROM k""")
def G07_component_summary(spark, sf_dir):
    return r6(G.component_summary(*load_graph(spark, sf_dir, "gs")))


@query(f"WITH {_G} SELECT node FROM d WHERE degree = 0")
def G08_isolated_nodes(spark, sf_dir):
    return G.isolated(*_gp(spark, sf_dir))


@query(f"""WITH {_G}{_SUP}, t AS (SELECT node, sum(support) / 2 AS t FROM (SELECT u AS node, support FROM sup UNION ALL SELECT v, support FROM sup) GROUP BY node)
SELECT round(avg(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END), 6) AS clustering FROM d LEFT JOIN t USING (node)""")
def G09_clustering(spark, sf_dir):
    return r6(G.clustering(*_gp(spark, sf_dir)))


@query(f"WITH {_G} SELECT round(coalesce(avg((a.label = c.label)::INT::DOUBLE), 0), 6) AS homophily FROM e JOIN n a ON a.node = e.u JOIN n c ON c.node = e.v")
def G10_homophily(spark, sf_dir):
    return r6(G.homophily(*_gp(spark, sf_dir)))


@query(f"""WITH {_G}, b2 AS (SELECT u, v FROM b WHERE (u + v) % 5 <> 0), d2 AS (SELECT node, count(b2.u) AS degree FROM n LEFT JOIN b2 ON n.node = b2.u GROUP BY node),
p AS (SELECT degree, count(*) / (SELECT count(*) FROM n) AS p FROM d GROUP BY degree), q AS (SELECT degree, count(*) / (SELECT count(*) FROM n) AS q FROM d2 GROUP BY degree),
j AS (SELECT coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM p FULL JOIN q USING (degree))
SELECT round(sum(abs(p - q)) / 2, 6) AS tv, round((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS js FROM j""")
def G11_degree_tv_js(spark, sf_dir):
    nodes, edges = _gp(spark, sf_dir)
    return r6(G.degree_distances(nodes, edges, edges.filter("(u + v) % 5 <> 0")))


@query("SELECT i::INT + 1 AS round, (37 // 8 + CASE WHEN i < 37 % 8 THEN 1 ELSE 0 END)::INT AS budget FROM range(0, 8) t(i)")
def G12_budget_split(spark, sf_dir):
    return spark.createDataFrame([(k + 1, b) for k, b in enumerate(G.split_budget(37, 8))], "round int, budget int")


@query(f"""WITH {_G}{_SUP} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT sum(degree * (degree - 1) // 2)::BIGINT FROM d) AS wedges,
(SELECT sum(support)::BIGINT // 3 FROM sup) AS triangles, (SELECT round(avg(degree), 6) FROM d) AS mean_degree, (SELECT max(degree) FROM d) AS max_degree""")
def G13_graph_profile(spark, sf_dir):
    return r6(G.profile(*_gp(spark, sf_dir)))


@query()
def G13_degeneracy(spark, sf_dir):
    return spark.createDataFrame([(G.degeneracy(_gp(spark, sf_dir)[1]),)], "degeneracy int")


@query(f"""WITH {_G}, x AS (SELECT u, v, u % 3 <> 0 AS a, v % 3 <> 0 AS c FROM e)
SELECT count(*) FILTER (a AND c) AS shared, count(*) FILTER (a OR c) AS either, round(count(*) FILTER (a AND c) / count(*) FILTER (a OR c), 6) AS jaccard FROM x""")
def G14_edge_jaccard(spark, sf_dir):
    edges = _gp(spark, sf_dir)[1]
    return r6(G.jaccard(edges.filter("u % 3 <> 0"), edges.filter("v % 3 <> 0")))


@query(f"WITH {_G} SELECT sha256(string_agg(u || ',' || v, ';' ORDER BY u, v)) AS sha256 FROM e")
def G15_edge_hash(spark, sf_dir):
    return G.edge_hash(_gp(spark, sf_dir)[1])


@query("SELECT 'ring' AS family, least(i, (i + s) % 100) AS u, greatest(i, (i + s) % 100) AS v FROM range(0, 100) t(i), (VALUES (1), (2)) x(s) UNION ALL SELECT 'star', 0, i FROM range(1, 50) t(i)")
def S22_synthetic_graphs(spark, sf_dir):
    a, b = ring(spark, 100), star(spark, 50)
    return a.select(F.lit("ring").alias("family"), "u", "v").unionByName(b.select(F.lit("star").alias("family"), "u", "v"))


@query(f"WITH {_G}{_GRAPHLETS} SELECT size, mask, count(*) AS graphlets FROM g GROUP BY ALL")
def O02_graphlets_by_mask(spark, sf_dir):
    return O.graphlets(_gp(spark, sf_dir)[1]).groupBy("size", "mask").agg(F.count("*").alias("graphlets"))


@query(f"WITH {_G}{_GRAPHLETS} SELECT node, {_WIDE} FROM gl GROUP BY node")
def O02_gdv_graphlet(spark, sf_dir):
    nodes, edges = _gp(spark, sf_dir)
    return O.wide(O.gdv_long(nodes, O.graphlets(edges)))


@query(f"WITH {_G}{_GRAPHLETS} SELECT node, {_WIDE} FROM gl GROUP BY node")
def gdv_closed(spark, sf_dir):
    return O.gdv_closed(*_gp(spark, sf_dir))


#: Every graph on 2 to 4 places by its bits; a place's orbit follows from the degrees.
_MASK_RULE = """WITH pr(i, j, bit) AS (VALUES (0, 1, 1), (0, 2, 2), (0, 3, 4), (1, 2, 8), (1, 3, 16), (2, 3, 32)),
a AS (SELECT s.size::INT AS size, m.mask::INT AS mask, p.place::INT AS place, (SELECT count(*) FROM pr WHERE (m.mask & bit) <> 0 AND (i = p.place OR j = p.place)) AS d
  FROM range(2, 5) s(size), range(1, 64) m(mask), range(0, 4) p(place) WHERE p.place < s.size AND NOT EXISTS (SELECT 1 FROM pr WHERE (m.mask & bit) <> 0 AND j >= s.size)),
g AS (SELECT size, mask, min(d) AS low, max(d) AS high, sum(d) // 2 AS edges FROM a GROUP BY ALL)
SELECT size, mask, place, (CASE WHEN size = 2 THEN 0 WHEN size = 3 AND edges = 2 THEN d WHEN size = 3 THEN 3 WHEN edges = 3 AND high = 3 THEN CASE d WHEN 1 THEN 6 ELSE 7 END
  WHEN edges = 3 THEN 3 + d WHEN edges = 4 AND high = 2 THEN 8 WHEN edges = 4 THEN 8 + d WHEN edges = 5 THEN 10 + d ELSE 14 END)::INT AS orbit
FROM a JOIN g USING (size, mask) WHERE low > 0 AND edges >= size - 1"""


@query(_MASK_RULE)
def O06_mask_table(spark, sf_dir):
    return O.mask_table(spark)


def _long(spark, sf_dir):
    return O.to_long(O.gdv_closed(*_gp(spark, sf_dir)))


@query(f"WITH {_G}{_GRAPHLETS} SELECT orbit, round(mu, 6) AS mu, round(sd, 6) AS sd FROM st")
def O11_gdv_stats(spark, sf_dir):
    return r6(O.standardization(_long(spark, sf_dir)))


@query(f"WITH {_G}{_GRAPHLETS} SELECT gl.node, gl.orbit, gl.cnt, round((ln(1.0 + cnt) - mu) / sd, 6) + 0.0 AS z FROM gl JOIN st USING (orbit)")
def O12_gdv_standardized(spark, sf_dir):
    long = materialize(_long(spark, sf_dir), "gdv")
    return r6(O.standardized(long, O.standardization(long)))


def _moves(spark, sf_dir):
    nodes, edges = _gp(spark, sf_dir)
    found = materialize(O.graphlets(edges), "graphlets")
    return nodes, edges, found, S.transitions(found)


@query(f"WITH {_G}{_GRAPHLETS}{_MOVES} SELECT u, v, node, orbit, delta FROM de")
def O09_edge_delta(spark, sf_dir):
    return S.raw_delta(_moves(spark, sf_dir)[3])


@query(f"WITH {_G}{_GRAPHLETS}{_MOVES} SELECT u, v, node, orbit, delta FROM de WHERE node IN (u, v)")
def O10_edge_endpoint_delta(spark, sf_dir):
    return endpoint_delta(mask_histogram(*_gp(spark, sf_dir)))


@query(f"WITH {_G}{_GRAPHLETS}{_MOVES} SELECT u, v, src, dst, count(*) AS n FROM mv GROUP BY ALL")
def O13_edge_transition(spark, sf_dir):
    return S.transition_matrix(_moves(spark, sf_dir)[3])


_SUMMARY = """,
su AS (SELECT u, v, orbit, sum(l)::BIGINT AS loss, sum(g)::BIGINT AS gain FROM (SELECT u, v, src AS orbit, 1 AS l, 0 AS g FROM mv WHERE src <> dst UNION ALL SELECT u, v, dst, 0, 1 FROM mv WHERE src <> dst AND dst < 15) GROUP BY ALL)"""


@query(f"WITH {_G}{_GRAPHLETS}{_MOVES}{_SUMMARY} SELECT u, v, orbit, loss, gain, gain - loss AS net FROM su")
def O14_transition_summary(spark, sf_dir):
    return S.transition_summary(S.transition_matrix(_moves(spark, sf_dir)[3]))


@query(f"WITH {_G}{_GRAPHLETS}{_MOVES}{_SUMMARY} SELECT u, v FROM (SELECT u, v, sum(gain - loss) AS net FROM su GROUP BY ALL) x JOIN (SELECT u, v, count(*) FILTER (dst = 15) AS gone FROM mv GROUP BY ALL) y USING (u, v) WHERE net <> -gone")
def O15_event_invariants(spark, sf_dir):
    m = S.transition_matrix(_moves(spark, sf_dir)[3])
    net = S.transition_summary(m).groupBy("u", "v").agg(F.sum("net").alias("net"))
    gone = m.groupBy("u", "v").agg(F.sum(F.when(F.col("dst") == S.DESTROYED, F.col("n")).otherwise(0)).alias("gone"))
    return net.join(gone, ["u", "v"]).filter("net <> -gone").select("u", "v")


def _scores(spark, sf_dir, mode, weights=None):
    nodes, edges = _gp(spark, sf_dir)
    edges = materialize(edges, "edges")
    long = materialize(O.to_long(O.gdv_closed(nodes, edges)), "gdv")
    delta = endpoint_delta(mask_histogram(nodes, edges))
    return nodes, edges, materialize(S.edge_scores(edges, long, O.standardization(long), delta, mode, weights=weights), "scores")


_SCORED = "u, v, round({0}, 6) AS score, round(mean_abs, 6) AS mean_abs, round(mean_rel, 6) AS mean_rel, round(mean_denom, 6) AS mean_denom, round(min_denom, 6) AS min_denom"


@query(f"WITH {_G}{_GRAPHLETS}{_score_sql()} SELECT {_SCORED.format('mean_abs')} FROM sc")
def R04_edge_scores_absolute(spark, sf_dir):
    return r6(_scores(spark, sf_dir, "absolute")[2])


@query(f"WITH {_G}{_GRAPHLETS}{_score_sql()} SELECT {_SCORED.format('mean_rel')} FROM sc")
def R05_edge_scores_relative(spark, sf_dir):
    return r6(_scores(spark, sf_dir, "relative")[2])


@query(f"WITH {_G}{_GRAPHLETS}{_score_sql('(gl.orbit % 4) * 0.5')} SELECT {_SCORED.format('mean_rel')} FROM sc")
def R06_edge_scores_weighted(spark, sf_dir):
    w = spark.range(O.ORBITS).select(F.col("id").cast("int").alias("orbit"), ((F.col("id") % 4) * 0.5).cast("double").alias("w"))
    return r6(_scores(spark, sf_dir, "relative", w)[2])


_GUARD = ", gu AS (SELECT e.u, e.v, a.degree + c.degree AS degree, CASE WHEN least(a.degree, c.degree) - 1 < 2 THEN 'd_min_guard' ELSE 'eligible' END AS reason FROM e JOIN d a ON a.node = e.u JOIN d c ON c.node = e.v)"


@query(f"WITH {_G}{_GUARD} SELECT u, v, degree, reason FROM gu")
def P06_guard_reasons(spark, sf_dir):
    return S.guard_reasons(*_gp(spark, sf_dir))


@query(f"WITH {_G}{_GUARD} SELECT reason, count(*) AS edges FROM gu GROUP BY reason")
def R09_guard_counts(spark, sf_dir):
    return S.guard_reasons(*_gp(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("edges"))


@query(f"WITH {_G}{_GRAPHLETS}{_score_sql()}{_GUARD}{_SUP} SELECT u, v, round(mean_rel, 6) AS score, degree, support::BIGINT AS support FROM sc JOIN gu USING (u, v) JOIN sup USING (u, v) WHERE reason = 'eligible' ORDER BY mean_rel, degree, support, u, v LIMIT 50")
def R07_batch_round_topk(spark, sf_dir):
    nodes, edges, scores = _scores(spark, sf_dir, "relative")
    return r6(S.ranked_candidates(nodes, edges, scores, 2).orderBy("score", "degree", "support", "u", "v").limit(50))


@query()
def R02_batch_prune(spark, sf_dir):
    """Three rounds of batch pruning of a tenth of the edges."""
    return S.batch_prune(*load_graph(spark, sf_dir, "gs"), rho=0.1, rounds=3, guard_bridges=True, d_min=1)[1]


@query()
def R18_batch_rounds(spark, sf_dir):
    """What each round of R02 was asked for, what its guards left and blocked, and what it took."""
    return S.batch_rounds(*load_graph(spark, sf_dir, "gs"), rho=0.1, rounds=3, guard_bridges=True, d_min=1)[2]


def _pruned(spark, sf_dir):
    nodes, edges = _gp(spark, sf_dir)
    return nodes, edges, edges.filter("(u + v) % 5 <> 0")


@query(f"""WITH {_G}{_GRAPHLETS}, keep AS (SELECT g.n, g.size, (g.mask - coalesce(sum(pr.bit) FILTER (pr.j <= g.size AND (g.mask & pr.bit) <> 0 AND (g.n[pr.i] + g.n[pr.j]) % 5 = 0), 0))::INT AS mask FROM g, pr GROUP BY g.n, g.size, g.mask),
gl2 AS (SELECT gl.node, gl.orbit, gl.cnt, coalesce(c.cnt, 0) AS now FROM gl LEFT JOIN (SELECT keep.n[mk.place + 1] AS node, mk.orbit, count(*) AS cnt FROM keep JOIN mk USING (size, mask) GROUP BY ALL) c USING (node, orbit)),
p AS (SELECT node, sum(abs((ln(1.0 + cnt) - mu) / sd - (ln(1.0 + now) - mu) / sd)) AS sig, 1e-8 + sum(abs((ln(1.0 + cnt) - mu) / sd)) AS norm FROM gl2 JOIN st USING (orbit) GROUP BY node)
SELECT round(avg(sig), 6) AS mean_delta_sig, round(median(sig), 6) AS median_delta_sig, round(avg(sig / norm), 6) AS mean_delta_rel, round(median(sig / norm), 6) AS median_delta_rel FROM p""")
def A08_structural_distortion(spark, sf_dir):
    nodes, edges, left = _pruned(spark, sf_dir)
    one = materialize(O.to_long(O.gdv_closed(nodes, edges)), "gdv")
    return r6(S.structural_metrics(one, O.to_long(O.gdv_closed(nodes, left)), O.standardization(one)))


@query(f"""WITH {_G}{_GRAPHLETS}, keep AS (SELECT g.n, g.size, (g.mask - coalesce(sum(pr.bit) FILTER (pr.j <= g.size AND (g.mask & pr.bit) <> 0 AND (g.n[pr.i] + g.n[pr.j]) % 5 = 0), 0))::INT AS mask FROM g, pr GROUP BY g.n, g.size, g.mask),
gl2 AS (SELECT gl.node, gl.orbit, gl.cnt, coalesce(c.cnt, 0) AS now FROM gl LEFT JOIN (SELECT keep.n[mk.place + 1] AS node, mk.orbit, count(*) AS cnt FROM keep JOIN mk USING (size, mask) GROUP BY ALL) c USING (node, orbit))
SELECT orbit, sum(cnt)::BIGINT AS initial_total, sum(now)::BIGINT AS current_total, sum(now - cnt)::BIGINT AS signed_delta, sum(abs(now - cnt))::BIGINT AS abs_delta, round(sum(now - cnt) / greatest(abs(sum(cnt)), 1), 6) + 0.0 AS relative_delta,
round(avg(abs(now - cnt)), 6) AS mean_abs_delta, max(abs(now - cnt)) AS max_abs_delta, count(*) FILTER (now <> cnt) AS changed_nodes, count(*) FILTER (now <> 0) AS nonzero_nodes, round(sqrt(sum((now - cnt) * (now - cnt))), 6) AS l2 FROM gl2 GROUP BY orbit""")
def A10_checkpoint_orbits(spark, sf_dir):
    nodes, edges, left = _pruned(spark, sf_dir)
    return r6(S.checkpoint(O.to_long(O.gdv_closed(nodes, edges)), O.to_long(O.gdv_closed(nodes, left))))


_GROUPS_SQL = " ".join(f"WHEN orbit IN ({', '.join(map(str, own))}) THEN '{g}'" for g, own in O.GROUPS.items())


@query(f"""WITH o AS (SELECT unnest(range(0, 15))::INT AS orbit), g AS (SELECT orbit, CASE {_GROUPS_SQL} END AS grp FROM o),
v AS (SELECT 'uniform' AS variant, orbit, 1.0::DOUBLE AS w FROM o UNION ALL SELECT 'leave_orbit_' || x.orbit, o.orbit, (x.orbit <> o.orbit)::INT::DOUBLE FROM o, o x
UNION ALL SELECT 'leave_' || x.grp, g.orbit, (x.grp <> g.grp)::INT::DOUBLE FROM g, (SELECT DISTINCT grp FROM g) x)
SELECT variant, orbit, round(w / sum(w) OVER (PARTITION BY variant), 6) AS sum_one, round(w * 15 / sum(w) OVER (PARTITION BY variant), 6) AS mean_one FROM v""")
def W06_ablation_weights(spark, sf_dir):
    w = S.leave_out_weights(spark)
    a, b = S.normalized_weights(w, "sum_one", ["variant"]), S.normalized_weights(w, "mean_one", ["variant"])
    return r6(a.withColumnRenamed("w", "sum_one").join(b.withColumnRenamed("w", "mean_one"), ["variant", "orbit"]))


@query("SELECT g.b AS guard_bridges, d.d::INT AS d_min FROM (VALUES (true), (false)) g(b), (VALUES (0), (2)) d(d)")
def W07_guard_ablation(spark, sf_dir):
    return spark.createDataFrame([(b, d) for b in (True, False) for d in (0, 2)], "guard_bridges boolean, d_min int")


_P = ", p AS (SELECT e.u, e.v, (1.0 / a.degree + 1.0 / c.degree) / sum(1.0 / a.degree + 1.0 / c.degree) OVER () AS p FROM e JOIN d a ON a.node = e.u JOIN d c ON c.node = e.v)"


@query(f"WITH {_G}{_P} SELECT u, v, round(p, 9) AS p FROM p")
def B03_dspar_probabilities(spark, sf_dir):
    return B.edge_probabilities(*_gp(spark, sf_dir)).select("u", "v", F.round("p", 9).alias("p"))


@query(f"WITH {_G} SELECT e.eps, floor(0.16 * m * ln(m) / (eps * eps))::BIGINT AS samples FROM (SELECT count(*)::DOUBLE AS m FROM n), (VALUES (0.3::DOUBLE), (0.7::DOUBLE), (1.1::DOUBLE)) e(eps)")
def B02_dspar_budget(spark, sf_dir):
    n = _gp(spark, sf_dir)[0].count()
    return spark.createDataFrame([(x, B.sample_budget(n, x)) for x in (0.3, 0.7, 1.1)], "eps double, samples long")


@query(f"WITH {_G}{_P} SELECT u, v, round(sum(p) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING), 6) AS hi FROM p")
def N02_dspar_cdf(spark, sf_dir):
    return r6(B.cumulative(B.edge_probabilities(*_gp(spark, sf_dir))).select("u", "v", "hi"))


@query(f"""WITH {_G}{_P}, c AS (SELECT u, v, sum(p) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS hi, sum(p) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING) - p AS lo FROM p),
x AS (SELECT ((i * 7919 + 13) % 100003 + 0.5) / 100003 AS x FROM range(0, 2000) t(i)) SELECT u, v, count(*) AS samples FROM c JOIN x ON x.x > c.lo AND x.x <= c.hi GROUP BY u, v""")
def J07_dspar_sample_arithmetic(spark, sf_dir):
    x = spark.range(2000).select((((F.col("id") * 7919 + 13) % 100003 + 0.5) / 100003).alias("x"))
    return B.sample_edges(B.cumulative(B.edge_probabilities(*_gp(spark, sf_dir))), x).select("u", "v", "samples")


@query()
def B01_dspar_sample(spark, sf_dir):
    return B.dspar(*_gp(spark, sf_dir), epsilon=0.7)


def _featured(spark, sf_dir):
    """The gp graph with three features of a part's table row."""
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_partkey") % 7).cast("double")).alias("features"))
    return _gp(spark, sf_dir)[1], f


_F = """, f AS (SELECT p_partkey AS node, [p_size::DOUBLE, p_retailprice, (p_partkey % 7)::DOUBLE] AS f FROM part),
ps AS (SELECT b.u, b.v, row_number() OVER (PARTITION BY b.u ORDER BY CASE WHEN b.v > b.u THEN 0 ELSE 1 END, b.v)::INT AS pos, list_concat(x.f, y.f) AS x FROM b JOIN f x ON x.node = b.u JOIN f y ON y.node = b.v)"""
_PLANES = [([0, 3, 5], [1.5, -2.25, 4.0], 3.0), ([1, 4, 2], [0.5, 0.25, -8.0], 1.0)]
_HASH = ", h AS (SELECT u, v, pos, " + ", ".join(
    "floor((" + " + ".join([repr(b)] + [f"x[{i + 1}] * ({c!r})" for i, c in zip(d, p)]) + f") / 16.0)::BIGINT AS h{k}" for k, (d, p, b) in enumerate(_PLANES)
) + " FROM ps)"


@query(f"WITH {_G}{_F}{_HASH} SELECT u, v, pos, h0, h1 FROM h")
def B08_projection_hash(spark, sf_dir):
    h = B.projection_hashes(B.edge_features(*_featured(spark, sf_dir)), _PLANES, 16.0)
    return h.select("u", "v", "pos", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1"))


@query(f"""WITH {_G}{_F}{_HASH}, a AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY h0, pos) AS k FROM h) WHERE k = 1),
c AS (SELECT u, v FROM (SELECT h.u, h.v, row_number() OVER (PARTITION BY h.u ORDER BY h1, pos) AS k FROM h ANTI JOIN a ON a.u = h.u AND a.v = h.v) WHERE k = 1)
SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM c)""")
def B12_lsp_select(spark, sf_dir):
    h = B.projection_hashes(B.edge_features(*_featured(spark, sf_dir)), _PLANES, 16.0)
    return G.canonical_edges(B.select_winners(h, 2))


@query(f"WITH {_G}{_F}, t AS (SELECT u, v, CASE WHEN x[1] <= 20 THEN '1' ELSE '0' END || CASE WHEN x[5] <= 1500 THEN '1' ELSE '0' END || CASE WHEN x[3] <= 2 THEN '1' ELSE '0' END AS signature FROM ps) "
       "SELECT u, v, signature, ('0x' || substr(md5(signature), 1, 8))::BIGINT % 2147483647 AS token, (12345 * (('0x' || substr(md5(signature), 1, 8))::BIGINT % 2147483647) + 678) % 2147483647 AS h FROM t")  # fmt: skip
def B10_threshold_signature(spark, sf_dir):
    s = B.threshold_signature(B.edge_features(*_featured(spark, sf_dir)), [0, 4, 2], [20.0, 1500.0, 2.0])
    return B.permutation_hashes(s, "token", [(12345, 678)]).select("u", "v", "signature", "token", F.col("h")[0].alias("h"))


@query(f"WITH {_G}, w AS (SELECT u, v FROM b UNION ALL SELECT node, node FROM n) SELECT w.u AS node, round(sum(p_size / sqrt((x.degree + 1) * (y.degree + 1))), 6) AS h FROM w JOIN part ON p_partkey = w.v JOIN d x ON x.node = w.u JOIN d y ON y.node = w.v GROUP BY w.u")
def T01_gcn_propagate(spark, sf_dir):
    """One step of symmetric normalised propagation of p_size, self-loops included."""
    nodes, edges = _gp(spark, sf_dir)
    d = G.degrees(nodes, edges)
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), "p_size")
    w = G.bidirectional(edges).unionByName(nodes.select(F.col("node").alias("u"), F.col("node").alias("v")))
    j = w.join(f, "v").join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    return r6(j.groupBy(F.col("u").alias("node")).agg(F.sum(F.col("p_size") / F.sqrt((F.col("du") + 1) * (F.col("dv") + 1))).alias("h")))


@query(f"WITH {_G} SELECT u AS node, round(avg(p_size), 6) AS h FROM b JOIN part ON p_partkey = b.v GROUP BY u")
def T03_sage_mean(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), "p_size")
    return r6(G.bidirectional(_gp(spark, sf_dir)[1]).join(f, "v").groupBy(F.col("u").alias("node")).agg(F.avg("p_size").alias("h")))


@query()
def R16_sequential_trajectory(spark, sf_dir):
    """The deletions of a tenth of the sparse graph's edges, one at a time, under both guards."""
    from lattica.operators.sequential import sequential_prune

    return sequential_prune(*load_graph(spark, sf_dir, "gs"), rho=0.1, d_min=0, guard_bridges=True)


@query()
def C04_calibrate_orbit_shift(spark, sf_dir):
    from lattica.plans.pipelines import TARGETS, calibrate_orbit_shift

    return calibrate_orbit_shift(*load_graph(spark, sf_dir, "gs"), targets=TARGETS, d_min=0)


@query()
def C05_calibrate_dspar(spark, sf_dir):
    from lattica.plans.pipelines import TARGETS, calibrate_dspar

    return calibrate_dspar(*_gp(spark, sf_dir), targets=TARGETS)


@query()
def C06_calibrate_lsp(spark, sf_dir):
    from lattica.plans.pipelines import calibrate_lsp

    return calibrate_lsp(*_featured(spark, sf_dir), 3)


@query()
def C02_prune_and_measure(spark, sf_dir):
    from lattica.plans.pipelines import prune_and_measure

    return prune_and_measure(*load_graph(spark, sf_dir, "gs"), "orbit_shift", 0.05, rounds=1, d_min=0)[1]


@query(f"""WITH {_G}{_SUP}, k AS (SELECT u, v FROM e WHERE (u + v) % 5 <> 0) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM k) AS kept,
(SELECT round(coalesce(avg((a.label = c.label)::INT::DOUBLE), 0), 6) FROM k JOIN n a ON a.node = k.u JOIN n c ON c.node = k.v) AS pruned_homophily,
(SELECT count(*) FROM n WHERE node NOT IN (SELECT u FROM k UNION SELECT v FROM k)) AS pruned_isolated""")
def A09_structural_controls(spark, sf_dir):
    from lattica.plans.pipelines import structural_controls

    nodes, edges, kept = _pruned(spark, sf_dir)
    return r6(structural_controls(nodes, edges, kept)).select("edges", "kept", "pruned_homophily", "pruned_isolated")


@query()
def T02_train_and_evaluate(spark, sf_dir):
    from lattica.plans.pipelines import graph_features, train_on_graph

    nodes, edges = _gp(spark, sf_dir)
    return r6(train_on_graph(nodes, edges, graph_features(spark, table(spark, sf_dir, "part")), ["x0", "x1"], "sage"))


@query(f"""WITH {_G}{_GRAPHLETS}{_MOVES}{_SUMMARY}, i AS (SELECT u, v, row_number() OVER (ORDER BY u, v) AS round FROM e)
SELECT round, orbit, gain - loss AS net, sum(gain - loss) OVER (PARTITION BY orbit ORDER BY round ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative_net FROM su JOIN i USING (u, v)""")
def A12_cumulative_events(spark, sf_dir):
    from lattica.plans.pipelines import cumulative_events

    nodes, edges, found, moves = _moves(spark, sf_dir)
    order = G.edge_ids(edges).withColumn("round", F.col("edge_id") + 1)
    return cumulative_events(S.transition_matrix(moves), order)


_SPLIT = "CASE p_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


@query(f"""WITH {_G} SELECT 'node' AS kind, p_partkey AS u, p_partkey AS v, p_brand AS label, {_SPLIT} AS split, 0.0::DOUBLE AS weight FROM part
UNION ALL SELECT 'edge', e.u, e.v, '', '', round(1.0 / a.degree + 1.0 / c.degree, 6) FROM e JOIN d a ON a.node = e.u JOIN d c ON c.node = e.v""")
def P07_replaced_bundle(spark, sf_dir):
    """The sparse graph with all edges of the dense one in place of its own, weighted: a row a node with label and split as before, and a row an edge."""
    old = load_graph(spark, sf_dir, "gs")[0]
    fifth = F.col("node") % 5
    old = old.withColumn("split", F.when(fifth == 0, "test").when(fifth == 1, "val").otherwise("train"))
    every = _gp(spark, sf_dir)
    d = G.degrees(*every)
    new = every[1].join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v").withColumn("w", 1.0 / F.col("du") + 1.0 / F.col("dv"))
    nodes, edges = G.replace_edges(old, new, "w")
    own = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("u"), F.col("node").alias("v"), "label", "split", F.lit(0.0).alias("weight"))
    return r6(own.unionByName(edges.select(F.lit("edge").alias("kind"), "u", "v", F.lit("").alias("label"), F.lit("").alias("split"), "weight")))


@query(f"WITH {_G}{_GRAPHLETS} SELECT pr.bit AS slot, count(*) AS edges FROM g JOIN pr ON (g.mask & pr.bit) <> 0 WHERE g.size = 4 GROUP BY pr.bit")
def O07_relevant_subsets(spark, sf_dir):
    """Four-node graphlets by the slot in which they hold an edge."""
    found = O.graphlets(_gp(spark, sf_dir)[1]).filter("size = 4")
    bits = F.explode(F.array(*[F.lit(1 << k) for k in range(6)]))
    return found.select("mask", bits.alias("slot")).filter("(mask & slot) <> 0").groupBy("slot").agg(F.count("*").alias("edges"))


@query(f"WITH {_G}{_GRAPHLETS}{_MOVES} SELECT u, v, node, orbit, delta FROM de WHERE node IN (u, v)")
def O10_endpoint_delta_enumerated(spark, sf_dir):
    """The deltas of O10 from the table of graphlets."""
    return S.raw_delta(_moves(spark, sf_dir)[3], endpoints_only=True)


@query(f"WITH {_G}{_GRAPHLETS}, hi AS (SELECT g.n[pr.i] AS u, g.n[pr.j] AS v, g.size, bit_count(g.mask) AS edges FROM g JOIN pr ON (g.mask & pr.bit) <> 0) SELECT u, v, size, edges::INT AS edges, count(*) AS n FROM hi GROUP BY ALL")
def O08_shapes_by_edge(spark, sf_dir):
    """Graphlets that hold an edge by their size and number of edges, counted in closed form."""
    h = mask_histogram(*_gp(spark, sf_dir))
    return h.groupBy("u", "v", "size", F.bit_count("mask").alias("edges")).agg(F.sum("n").alias("n"))


@query(f"WITH {_G}{_GRAPHLETS}{_score_sql()} SELECT {_SCORED.format('mean_rel')} FROM sc")
def R05_edge_scores_closed(spark, sf_dir):
    """All edges' scores from closed forms alone: the scoring that hubs don't break."""
    nodes, edges = _gp(spark, sf_dir)
    long = materialize(_long(spark, sf_dir), "gdv")
    return r6(S.edge_scores(edges, long, O.standardization(long), endpoint_delta(mask_histogram(nodes, edges)), "relative"))


@query(f"WITH {_G} SELECT row_number() OVER (ORDER BY node) - 1 AS place, node FROM n WHERE node % 4 = 1")
def S03_mask_to_index(spark, sf_dir):
    """Nodes of a split mask as an index list."""
    nodes = _gp(spark, sf_dir)[0].withColumn("mask", F.array(F.col("node") % 4 == 0, F.col("node") % 4 == 1))
    held = nodes.select("node", F.posexplode("mask").alias("split", "own")).filter("split = 1 and own").select("node")
    from pyspark.sql import Window as W

    return held.select((F.row_number().over(W.orderBy("node")) - 1).cast("long").alias("place"), "node")


@query(f"WITH {_G}, x AS (SELECT u, v FROM e WHERE u % 2 = 0), y AS (SELECT u, v FROM e WHERE v % 2 = 0) SELECT 'both' AS part, count(*) AS edges FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)")
def L06_edge_set_algebra(spark, sf_dir):
    edges = _gp(spark, sf_dir)[1]
    x, y = edges.filter("u % 2 = 0"), edges.filter("v % 2 = 0")
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("edges"))
    return n(x.intersect(y), "both").unionByName(n(x.subtract(y), "first")).unionByName(n(x.union(y).distinct(), "either"))


@query(f"WITH {_G}{_GRAPHLETS}{_score_sql()}{_GUARD}{_SUP} SELECT u, v, round(mean_rel, 6) AS score, degree, support::BIGINT AS support FROM sc JOIN gu USING (u, v) JOIN sup USING (u, v) WHERE reason = 'eligible' ORDER BY mean_rel, degree, support, u, v LIMIT 1")
def R08_best_edge(spark, sf_dir):
    """The round's best eligible edge by one reduction, without a sort."""
    nodes, edges, scores = _scores(spark, sf_dir, "relative")
    return r6(S.best_edge(S.ranked_candidates(nodes, edges, scores, 2)))

