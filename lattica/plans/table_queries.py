"""Queries of the results warehouse over deterministic projections of the star schema, each with the same result in SQL.

Runs: an event is a frontier row (dataset, method, achieved reduction, runtime);
an order is a training run (dataset, model, method, seed, target, accuracy).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.operators import tables as T
from lattica.plans.graph_queries import r6
from lattica.session import materialize, scratch, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FRONTIER = """fr AS (SELECT 'ds' || (user_id % 4) AS dataset, CASE event_type WHEN 'view' THEN 'orbit_shift' WHEN 'click' THEN 'dspar' ELSE 'lsp' END AS method,
((event_id * 7919) % 6007) / 10000.0::DOUBLE AS achieved, (event_id % 5)::INT AS pruning_seed, value AS runtime, event_id AS run FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
_TARGETS = ", tg AS (SELECT i / 20.0::DOUBLE AS target FROM range(1, 11) t(i))"
_MASTER = """ma AS (SELECT o_orderpriority AS dataset, CASE o_orderstatus WHEN 'F' THEN 'gcn' WHEN 'O' THEN 'sage' ELSE 'dense' END AS model,
CASE o_custkey % 3 WHEN 0 THEN 'orbit_shift' WHEN 1 THEN 'dspar' ELSE 'lsp' END AS method, (o_orderkey % 5)::INT AS seed, o_totalprice / 500000 AS accuracy, (o_totalprice % 1000) / 1000 AS macro_f1,
o_totalprice / 10000 AS train_sec, o_custkey % 40 AS artifact, o_orderkey AS run FROM orders)"""


def frontier(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    method = F.when(F.col("event_type") == "view", "orbit_shift").when(F.col("event_type") == "click", "dspar").otherwise("lsp")
    return e.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 4).cast("string")).alias("dataset"), method.alias("method"), (((F.col("event_id") * 7919) % 6007) / F.lit(10000.0)).alias("achieved"),
        (F.col("event_id") % 5).cast("int").alias("pruning_seed"), F.col("value").alias("runtime"), F.col("event_id").alias("run"),
    )


def targets(spark) -> DataFrame:
    return spark.range(1, 11).select((F.col("id") / F.lit(20.0)).alias("target"))


def master(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    model = F.when(F.col("o_orderstatus") == "F", "gcn").when(F.col("o_orderstatus") == "O", "sage").otherwise("dense")
    method = F.when(F.col("o_custkey") % 3 == 0, "orbit_shift").when(F.col("o_custkey") % 3 == 1, "dspar").otherwise("lsp")
    return o.select(
        F.col("o_orderpriority").alias("dataset"), model.alias("model"), method.alias("method"), (F.col("o_orderkey") % 5).cast("int").alias("seed"), (F.col("o_totalprice") / 500000).alias("accuracy"),
        ((F.col("o_totalprice") % 1000) / 1000).alias("macro_f1"), (F.col("o_totalprice") / 10000).alias("train_sec"), (F.col("o_custkey") % 40).alias("artifact"), F.col("o_orderkey").alias("run"),
    )


_NEAREST = _TARGETS + """, nt AS (SELECT dataset, method, target, arg_min(x, {'g': abs(x.achieved - target), 's': x.pruning_seed, 'r': x.run}) AS x
FROM (SELECT fr.dataset, fr.method, tg.target, {'achieved': achieved, 'pruning_seed': pruning_seed, 'runtime': runtime, 'run': run} AS x FROM fr, tg) GROUP BY ALL),
nn AS (SELECT dataset, method, target, x.achieved AS achieved, x.pruning_seed AS pruning_seed, x.runtime AS runtime, x.run AS run, abs(x.achieved - target) AS abs_gap FROM nt)"""


def matched(spark, sf_dir) -> DataFrame:
    return T.nearest_target(frontier(spark, sf_dir), targets(spark), ["dataset", "method"], "achieved", ["pruning_seed", "run"])


@query(f"WITH {_FRONTIER}{_NEAREST} SELECT dataset, method, target, achieved, pruning_seed, runtime, run, round(abs_gap, 6) AS abs_gap FROM nn")
def J05_nearest_target(spark, sf_dir):
    return matched(spark, sf_dir).withColumn("abs_gap", F.round("abs_gap", 6))


_GRID = ", gr AS (SELECT dataset, target, " + ", ".join(f"max({c}) FILTER (method = '{m}') AS {m}_{c}" for m in T.METHODS for c in ("achieved", "abs_gap")) + " FROM nn GROUP BY ALL)"
_GRID += ", gs AS (SELECT *, greatest(orbit_shift_abs_gap, dspar_abs_gap, lsp_abs_gap) AS worst_gap FROM gr)"
_GRID += f", gg AS (SELECT *, CASE WHEN orbit_shift_abs_gap IS NULL OR dspar_abs_gap IS NULL OR lsp_abs_gap IS NULL THEN 'unmatched' WHEN worst_gap <= {T.MAIN_GAP} THEN 'main' WHEN worst_gap <= {T.AUX_GAP} THEN 'auxiliary' ELSE 'unmatched' END AS status FROM gs)"
_ROUNDED = ", ".join(f"round({m}_{c}, 6) AS {m}_{c}" for m in T.METHODS for c in ("achieved", "abs_gap"))


@query(f"WITH {_FRONTIER}{_NEAREST}{_GRID} SELECT dataset, target, {_ROUNDED}, round(worst_gap, 6) AS worst_gap, status FROM gg")
def J06_common_grid(spark, sf_dir):
    return r6(T.common_grid(matched(spark, sf_dir)))


@query(f"WITH {_FRONTIER}{_NEAREST}{_GRID} SELECT dataset, count(*) AS targets, count(*) FILTER (status = 'main') AS main, count(*) FILTER (status = 'auxiliary') AS auxiliary, count(*) FILTER (status = 'unmatched') AS unmatched, round(avg(worst_gap), 6) AS mean_worst_gap FROM gg GROUP BY dataset")
def A04_coverage(spark, sf_dir):
    return r6(T.coverage(T.common_grid(matched(spark, sf_dir))))


@query(f"WITH {_FRONTIER}{_NEAREST}{_GRID} SELECT dataset, target, status, method, achieved FROM nn JOIN (SELECT dataset, target, status FROM gg) USING (dataset, target)")
def C08_training_manifest(spark, sf_dir):
    return T.training_manifest(T.common_grid(matched(spark, sf_dir)))


@query(f"WITH {_FRONTIER}{_NEAREST}{_GRID} SELECT dataset, target, status, method, achieved FROM nn JOIN (SELECT dataset, target, status FROM gg) USING (dataset, target) WHERE lower(method) IN ('lsp', 'dspar') AND status = 'main'")
def P09_manifest_filter(spark, sf_dir):
    return T.training_manifest(T.common_grid(matched(spark, sf_dir))).filter(F.lower("method").isin("lsp", "dspar") & (F.col("status") == "main"))


@query(f"WITH {_MASTER} SELECT dataset, model, method, count(*) AS runs, round(min(accuracy), 6) AS min_accuracy, round(max(accuracy), 6) AS max_accuracy, round(avg(accuracy), 6) AS mean_accuracy, round(avg(macro_f1), 6) AS mean_f1 FROM ma GROUP BY ALL")
def A01_frontier_summary(spark, sf_dir):
    m = master(spark, sf_dir)
    return r6(m.groupBy("dataset", "model", "method").agg(F.count("*").alias("runs"), F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"), F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f1").alias("mean_f1")))


def _lead(x: str, m: str) -> str:
    return f"orbit_shift_{x} - {m}_{x}"


_MEANS = ", mm AS (SELECT dataset, model, seed, " + ", ".join(f"avg({x}) FILTER (method = '{m}') AS {m}_{x}" for m in T.METHODS for x in ("accuracy", "macro_f1")) + " FROM ma GROUP BY ALL)"


@query(f"WITH {_MASTER}{_MEANS} SELECT dataset, model, seed, " + ", ".join(f"round({m}_{x}, 6) AS {m}_{x}" for m in T.METHODS for x in ("accuracy", "macro_f1")) + ", " + ", ".join(f"round({_lead(x, m)}, 6) + 0.0 AS {x}_lead_over_{m}" for m in T.METHODS[1:] for x in ("accuracy", "macro_f1")) + " FROM mm")
def A02_seed_level_means(spark, sf_dir):
    return r6(T.method_means(master(spark, sf_dir), ["dataset", "model", "seed"], ["accuracy", "macro_f1"]))


@query(f"WITH {_MASTER}{_MEANS} SELECT dataset, model, count(*) AS seeds, " + ", ".join(f"count(*) FILTER ({_lead('accuracy', m)} > 0) AS wins_over_{m}, round(avg({_lead('accuracy', m)}), 6) + 0.0 AS mean_over_{m}, round(coalesce(stddev_samp({_lead('accuracy', m)}), 0), 6) AS std_over_{m}" for m in T.METHODS[1:]) + " FROM mm GROUP BY ALL")
def A03_pairwise_summary(spark, sf_dir):
    return r6(T.pairwise_summary(T.method_means(master(spark, sf_dir), ["dataset", "model", "seed"], ["accuracy"]), ["dataset", "model"], "accuracy"))


@query(f"WITH {_FRONTIER} SELECT dataset, method, count(*) AS runs, round(sum(runtime), 4) AS total, round(avg(runtime), 6) AS mean, round(median(runtime), 6) AS median, min(runtime) AS least, max(runtime) AS greatest FROM fr GROUP BY ALL")
def A05_pruning_runtime(spark, sf_dir):
    x = F.col("runtime")
    return frontier(spark, sf_dir).groupBy("dataset", "method").agg(F.count("*").alias("runs"), F.round(F.sum(x), 4).alias("total"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("median"), F.min(x).alias("least"), F.max(x).alias("greatest"))


@query(f"WITH {_MASTER} SELECT dataset, method, count(*) AS runs, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(median({m}), 6) AS {m}_median, round(stddev_samp({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in ("train_sec", "accuracy")) + " FROM ma GROUP BY ALL")
def A06_runtime_rollup(spark, sf_dir):
    return r6(T.rollup(master(spark, sf_dir), ["dataset", "method"], ["train_sec", "accuracy"]))


@query(f"WITH {_MASTER}, q AS (SELECT dataset, model, avg(train_sec) FILTER (method = 'orbit_shift') AS a, avg(train_sec) FILTER (method = 'dspar') AS d, avg(train_sec) FILTER (method = 'lsp') AS l FROM ma GROUP BY ALL) SELECT dataset, model, round(a, 6) AS orbit_shift, round(d, 6) AS dspar, round(l, 6) AS lsp, round(a - d, 6) + 0.0 AS delta_dspar, round(a / nullif(d, 0), 6) AS ratio_dspar, round(a - l, 6) + 0.0 AS delta_lsp, round(a / nullif(l, 0), 6) AS ratio_lsp FROM q WHERE a IS NOT NULL AND d IS NOT NULL AND l IS NOT NULL")
def A07_runtime_pairwise(spark, sf_dir):
    return r6(T.runtime_ratios(master(spark, sf_dir), ["dataset", "model"], "train_sec"))


@query(f"WITH {_MASTER} SELECT run, count(*) OVER (PARTITION BY artifact) AS uses, round(train_sec / count(*) OVER (PARTITION BY artifact), 9) AS amortised FROM ma")
def N01_reuse_amortised(spark, sf_dir):
    return T.amortised(master(spark, sf_dir), "artifact", "train_sec").select("run", "uses", F.round("amortised", 9).alias("amortised"))


@query(f"WITH {_FRONTIER} SELECT dataset, method, run, achieved, k FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY abs(achieved - 0.3), run)::INT AS k FROM fr) WHERE k <= 3")
def N03_top3_per_target(spark, sf_dir):
    w = W.partitionBy("dataset", "method").orderBy(F.abs(F.col("achieved") - 0.3), "run")
    return frontier(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("dataset", "method", "run", "achieved", "k")


_FOLDS = ", fo AS (SELECT artifact, ((row_number() OVER (ORDER BY artifact) - 1) % 4)::INT AS fold FROM (SELECT DISTINCT artifact FROM ma))"


@query(f"WITH {_MASTER}{_FOLDS} SELECT artifact, fold FROM fo")
def N04_artifact_folds(spark, sf_dir):
    return T.folds(master(spark, sf_dir), "artifact", 4)


@query(f"""WITH {_MASTER}, c AS (SELECT DISTINCT model, artifact FROM ma), h AS (SELECT model AS value, artifact, ((row_number() OVER (PARTITION BY model ORDER BY artifact) - 1) % least(4, count(*) OVER (PARTITION BY model)))::INT AS fold FROM c),
s AS (SELECT DISTINCT value, fold FROM h), x AS (SELECT s.value, s.fold, CASE WHEN ma.model = s.value AND h.artifact IS NOT NULL THEN 'test' WHEN ma.model <> s.value AND h.artifact IS NULL THEN 'train' END AS role
FROM s CROSS JOIN ma LEFT JOIN h ON h.value = s.value AND h.fold = s.fold AND h.artifact = ma.artifact) SELECT value, fold, role, count(*) AS rows FROM x WHERE role IS NOT NULL GROUP BY ALL""")
def M05_outer_splits(spark, sf_dir):
    return T.held_out_splits(master(spark, sf_dir), "model", "artifact", 4)


@query(f"WITH {_MASTER}, r AS (SELECT run, model, sum(round(train_sec * 1000000)::BIGINT) OVER (PARTITION BY model ORDER BY run ROWS UNBOUNDED PRECEDING)::BIGINT AS micros FROM ma) SELECT run, model, micros FROM r")
def N05_running_totals(spark, sf_dir):
    w = W.partitionBy("model").orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)
    return master(spark, sf_dir).select("run", "model", F.sum(F.round(F.col("train_sec") * 1000000).cast("long")).over(w).alias("micros"))


@query(f"WITH {_MASTER}, k AS (SELECT rank() OVER (ORDER BY accuracy) + (count(*) OVER (PARTITION BY accuracy) - 1) / 2 AS a, rank() OVER (ORDER BY artifact) + (count(*) OVER (PARTITION BY artifact) - 1) / 2 AS b FROM ma) SELECT round(corr(a, b), 6) AS rho, count(*) AS rows FROM k")
def N06_spearman(spark, sf_dir):
    return r6(T.spearman(master(spark, sf_dir), "accuracy", "artifact"))


@query(f"WITH {_MASTER} SELECT dataset, model, min(run) AS run, arg_min(accuracy, run) AS accuracy FROM ma GROUP BY ALL")
def N07_first_per_group(spark, sf_dir):
    return master(spark, sf_dir).groupBy("dataset", "model").agg(F.min("run").alias("run"), F.min_by("accuracy", "run").alias("accuracy"))


@query(f"WITH {_MASTER}, x AS (SELECT dataset, model, method, seed, accuracy - 0.5 AS c FROM ma) SELECT dataset, method, count(*) AS folds, round(avg(c), 6) + 0.0 AS mean, round(stddev_pop(c), 6) AS std, round(median(c), 6) + 0.0 AS median, round(count(*) FILTER (abs(c) > 1e-12) / count(*), 6) AS nonzero_fraction, round(greatest(count(*) FILTER (c > 1e-12), count(*) FILTER (c < -1e-12)) / count(*) FILTER (abs(c) > 1e-12), 6) AS sign_consistency FROM x GROUP BY ALL")
def A13_coefficient_stability(spark, sf_dir):
    return r6(T.coefficient_stability(master(spark, sf_dir).withColumn("c", F.col("accuracy") - 0.5), ["dataset", "method"], "c"))


@query(f"WITH {_MASTER} SELECT model, method, round(avg(abs(accuracy - macro_f1)), 6) AS mae, round(sqrt(avg((accuracy - macro_f1) * (accuracy - macro_f1))), 6) AS rmse, round(1 - avg((accuracy - macro_f1) * (accuracy - macro_f1)) / var_pop(accuracy), 6) AS r2 FROM ma GROUP BY ALL")
def M08_regression_metrics(spark, sf_dir):
    return r6(T.regression_metrics(master(spark, sf_dir), ["model", "method"], "accuracy", "macro_f1"))


@query(f"WITH {_MASTER}, p AS (SELECT model, dataset, avg(abs(accuracy - macro_f1)) FILTER (method = 'orbit_shift') AS orbit_shift, avg(abs(accuracy - macro_f1)) FILTER (method = 'dspar') AS dspar, avg(abs(accuracy - macro_f1)) FILTER (method = 'lsp') AS lsp FROM ma GROUP BY ALL) SELECT model, dataset, round(orbit_shift, 6) AS orbit_shift, round(dspar, 6) AS dspar, round(lsp, 6) AS lsp FROM p")
def A15_mae_pivot(spark, sf_dir):
    m = master(spark, sf_dir).withColumn("e", F.abs(F.col("accuracy") - F.col("macro_f1")))
    return r6(m.groupBy("model", "dataset").pivot("method", list(T.METHODS)).agg(F.avg("e")))


@query(f"WITH {_MASTER} SELECT model, method, count(*) AS runs, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_samp(accuracy), 6) AS std_accuracy FROM ma GROUP BY ALL")
def A16_ablation_summary(spark, sf_dir):
    return r6(master(spark, sf_dir).groupBy("model", "method").agg(F.count("*").alias("runs"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy")))


@query("SELECT o_orderstatus AS family, count(*) AS points, round(regr_slope(ln(o_totalprice), ln(o_custkey)), 6) + 0.0 AS exponent, round(regr_intercept(ln(o_totalprice), ln(o_custkey)), 6) AS intercept, round(regr_r2(ln(o_totalprice), ln(o_custkey)), 6) AS r2 FROM orders WHERE o_totalprice > 0 AND o_custkey > 0 GROUP BY 1 HAVING count(*) >= 3")
def A18_loglog_fit(spark, sf_dir):
    return r6(T.loglog_fit(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "family"), ["family"], "o_custkey", "o_totalprice"))


@query(f"WITH {_MASTER} SELECT artifact, round(max(accuracy) - min(accuracy), 6) AS spread FROM ma GROUP BY artifact HAVING max(accuracy) - min(accuracy) > 1e-12")
def A19_artifact_invariance(spark, sf_dir):
    return r6(master(spark, sf_dir).groupBy("artifact").agg((F.max("accuracy") - F.min("accuracy")).alias("spread")).filter("spread > 1e-12"))


@query("WITH c AS (SELECT quality AS k FROM labels UNION SELECT toxic FROM labels), f AS (SELECT k, 2.0 * (SELECT count(*) FROM labels WHERE quality = k AND toxic = k) / ((SELECT count(*) FROM labels WHERE quality = k) + (SELECT count(*) FROM labels WHERE toxic = k)) AS f FROM c) SELECT (SELECT round(avg((quality = toxic)::INT::DOUBLE), 6) FROM labels) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f")
def A21_macro_f1(spark, sf_dir):
    return r6(T.classification(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("SELECT v.v AS variants, d.d AS datasets, r.r AS rhos, (v.v * d.d * r.r * 5)::INT AS prunes, (v.v * d.d * r.r * 5 * 2 * 5)::INT AS trainings FROM (VALUES (1), (22)) v(v), (VALUES (2)) d(d), (VALUES (5)) r(r)")
def A20_matrix_counts(spark, sf_dir):
    rows = [(v, 2, 5, v * 2 * 5 * 5, v * 2 * 5 * 5 * 2 * 5) for v in (1, 22)]
    return spark.createDataFrame(rows, "variants int, datasets int, rhos int, prunes int, trainings int")


@query("SELECT * FROM (VALUES (0, '0.0'), (100, '0.1'), (101, '0.101,0.1014'), (300, '0.3')) t(removed, rhos)")
def A11_checkpoint_targets(spark, sf_dir):
    rows = [(n, ",".join(repr(r) for r in rhos)) for n, rhos in T.checkpoint_targets(1000, 0.3, [0.1, 0.101, 0.1014, 0.5])]
    return spark.createDataFrame(rows, "removed int, rhos string")


@query(f"WITH {_MASTER}, x AS (SELECT 'orbit_' || (artifact % 15) || '_mean' AS feature, accuracy - 0.4 AS c FROM ma WHERE model = 'gcn') SELECT (string_split(feature, '_')[2])::INT AS orbit, round(greatest(avg(greatest(c, 0)), 0.01), 6) AS w FROM x GROUP BY 1")
def W04_derive_weights(spark, sf_dir):
    m = master(spark, sf_dir).withColumn("feature", F.concat(F.lit("orbit_"), (F.col("artifact") % 15).cast("string"), F.lit("_mean"))).withColumn("c", F.col("accuracy") - 0.4)
    return r6(T.derive_weights(m, "c", {"model": "gcn"}, floor=0.01))


@query(f"WITH {_MASTER} SELECT a.run, a.accuracy - b.accuracy AS drop FROM ma a JOIN (SELECT dataset, seed, max(accuracy) AS accuracy FROM ma WHERE model = 'dense' GROUP BY ALL) b USING (dataset, seed) WHERE a.model <> 'dense'")
def J01_dense_baseline_join(spark, sf_dir):
    m = master(spark, sf_dir)
    base = m.filter("model = 'dense'").groupBy("dataset", "seed").agg(F.max("accuracy").alias("base"))
    return m.filter("model <> 'dense'").join(base, ["dataset", "seed"]).select("run", (F.col("accuracy") - F.col("base")).alias("drop"))


@query(f"WITH {_FRONTIER}, {_MASTER} SELECT 'frontier' AS origin, dataset, method, run FROM fr UNION ALL SELECT 'master', dataset, method, run FROM ma")
def L05_union_tables(spark, sf_dir):
    f = frontier(spark, sf_dir).select(F.lit("frontier").alias("origin"), "dataset", "method", "run")
    return f.unionByName(master(spark, sf_dir).select(F.lit("master").alias("origin"), "dataset", "method", "run"))


@query(f"WITH {_MASTER} SELECT DISTINCT round(accuracy, 3) AS accuracy FROM ma")
def L04_distinct_rounded(spark, sf_dir):
    return master(spark, sf_dir).select(F.round("accuracy", 3).alias("accuracy")).distinct()


@query(f"WITH {_MASTER} SELECT dataset, model, method, seed, artifact, count(*) AS n FROM ma GROUP BY ALL HAVING count(*) > 1")
def L07_duplicate_keys(spark, sf_dir):
    return T.assert_unique(master(spark, sf_dir), ["dataset", "model", "method", "seed", "artifact"])


@query(f"WITH {_MASTER} SELECT artifact FROM ma WHERE model = 'gcn' INTERSECT SELECT artifact FROM ma WHERE model = 'sage' AND seed = 0")
def L08_split_overlap(spark, sf_dir):
    m = master(spark, sf_dir)
    return m.filter("model = 'gcn'").select("artifact").intersect(m.filter("model = 'sage' and seed = 0").select("artifact"))


@query("""WITH p AS (SELECT k.k::INT AS k, s.s / 20.0::DOUBLE AS sparsity FROM (VALUES (1), (2), (3), (5), (7), (9)) k(k), range(1, 20) s(s))
SELECT 'lsp_p' AS variant, k, sparsity, t.t::DOUBLE AS step FROM p, (VALUES (0.125), (0.25), (0.5), (1.0), (2.0), (4.0)) t(t) UNION ALL SELECT 'lsp_t', k, sparsity, NULL FROM p""")
def J13_parameter_grid(spark, sf_dir):
    """The 798 points of the coarse sweep: the projection variant has a step, the threshold variant none."""
    from lattica.plans.pipelines import LSP_KS, LSP_SPARSITIES, LSP_STEPS

    one = lambda values, name, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    points = one(LSP_KS, "k", "int").crossJoin(one([round(x, 2) for x in LSP_SPARSITIES], "sparsity", "double"))
    p = points.crossJoin(one(LSP_STEPS, "step", "double")).withColumn("variant", F.lit("lsp_p"))
    return p.unionByName(points.withColumns({"step": F.lit(None).cast("double"), "variant": F.lit("lsp_t")})).select("variant", "k", "sparsity", "step")


@query("SELECT event_id, ('{' || '\"k\":' || json_extract_string(props, '$.k') || '}') AS packed, json_extract_string(props, '$.k')::INT AS k FROM events")
def S08_json_fields(spark, sf_dir):
    """Nested values of a JSON column, typed and written again."""
    e = table(spark, sf_dir, "events").withColumn("j", F.from_json("props", "k int"))
    return e.select("event_id", F.to_json("j").alias("packed"), F.col("j.k").alias("k"))


@query(f"WITH {_MASTER} SELECT dataset, model, method, run, accuracy FROM ma")
def S09_csv_round_trip(spark, sf_dir):
    """Rows written as CSV with a header and read back under their schema."""
    m = master(spark, sf_dir).select("dataset", "model", "method", "run", "accuracy")
    path = scratch(spark, "csv")
    m.write.option("header", True).csv(path)
    return spark.read.schema(m.schema).option("header", True).csv(path)


@query(f"WITH {_MASTER} SELECT dataset, method, run, accuracy FROM ma WHERE dataset = '2-HIGH' AND method = 'lsp'")
def S13_artifact_round_trip(spark, sf_dir):
    """Runs written by dataset and method, and one partition of them read back."""
    path = scratch(spark, "runs")
    master(spark, sf_dir).select("dataset", "method", "run", "accuracy").repartition("dataset", "method").write.partitionBy("dataset", "method").parquet(path)
    return spark.read.parquet(path).filter("dataset = '2-HIGH' and method = 'lsp'").select("dataset", "method", "run", "accuracy")


@query("SELECT count(*) AS files, true AS verified FROM (VALUES (1)) t(x)")
def S18_file_manifest(spark, sf_dir):
    """Files of an artifact with sizes and SHA-256, verified by reading them again."""
    path = scratch(spark, "artifact")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    listed = materialize(files.select("path", "length", F.sha2("content", 256).alias("sha256")), "manifest")
    again = files.select("path", F.sha2("content", 256).alias("now"), F.col("length").alias("size"))
    j = listed.join(again, "path", "left")
    return j.agg(F.count("*").alias("files"), F.min((F.col("sha256") == F.col("now")) & (F.col("length") == F.col("size"))).alias("verified"))


_REG = "x AS (SELECT accuracy AS y, macro_f1 AS a, train_sec + artifact AS b, artifact FROM ma)"


@query(f"WITH {_MASTER}, {_REG} SELECT round(regr_slope(y, a), 6) + 0.0 AS slope, round(regr_intercept(y, a), 6) AS intercept, count(*) AS rows FROM x")
def M07_least_squares(spark, sf_dir):
    """Ridge without penalty on one column is the regression line."""
    from lattica.operators.learning import moments, ridge

    m = master(spark, sf_dir).select(F.col("accuracy").alias("y"), F.col("macro_f1").alias("a"))
    n, s = moments(m, ["a"], "y")
    beta = ridge(s, 0.0)
    return r6(spark.createDataFrame([(float(beta[1]), float(beta[0]), n)], "slope double, intercept double, rows long"))


@query()
def M06_grouped_regression(spark, sf_dir):
    """Penalty and coefficients chosen over grouped folds, and their permutation importance."""
    from lattica.operators.learning import grouped_ridge, permutation_importance

    m = master(spark, sf_dir).select("accuracy", "macro_f1", (F.col("train_sec") + F.col("artifact")).alias("cost"), "artifact")
    _, beta = grouped_ridge(m, ["macro_f1", "cost"], "accuracy", "artifact")
    return r6(permutation_importance(m, ["macro_f1", "cost"], beta, "accuracy", "artifact"))


@query()
def M11_bootstrap_spearman(spark, sf_dir):
    from lattica.operators.learning import bootstrap_spearman

    return r6(bootstrap_spearman(master(spark, sf_dir), "accuracy", "macro_f1", "artifact"))


@query(f"WITH {_MASTER} SELECT dataset, model, (seed % 3)::INT AS fold, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM ma GROUP BY ALL")
def A14_regression_summary(spark, sf_dir):
    m = master(spark, sf_dir).withColumn("fold", (F.col("seed") % 3).cast("int"))
    return r6(m.groupBy("dataset", "model", "fold").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std")))


@query(f"WITH {_MASTER} SELECT dataset, median(accuracy) AS accuracy, median(macro_f1) AS macro_f1, median(train_sec) AS train_sec FROM ma GROUP BY dataset")
def A17_median_of_repeats(spark, sf_dir):
    return master(spark, sf_dir).groupBy("dataset").agg(*[F.median(c).alias(c) for c in ("accuracy", "macro_f1", "train_sec")])


@query(f"WITH {_FRONTIER}{_NEAREST} SELECT nn.dataset, nn.method, nn.target, round(fr.runtime, 6) AS pruning_runtime FROM nn JOIN fr ON fr.run = nn.run")
def J11_runtime_by_target(spark, sf_dir):
    f = frontier(spark, sf_dir).select("run", F.col("runtime").alias("pruning_runtime"))
    return r6(matched(spark, sf_dir).select("dataset", "method", "target", "run").join(f, "run").drop("run"))


@query(f"""WITH {_FRONTIER}{_NEAREST}{_GRID}, {_MASTER}, t AS (SELECT model, seed, method, avg(accuracy) AS accuracy FROM ma GROUP BY ALL)
SELECT g.dataset, g.target, a.model, a.seed, round(a.accuracy, 6) AS orbit_shift, round(b.accuracy, 6) AS dspar, round(c.accuracy, 6) AS lsp FROM gg g, t a JOIN t b USING (model, seed) JOIN t c USING (model, seed)
WHERE g.status = 'main' AND a.method = 'orbit_shift' AND b.method = 'dspar' AND c.method = 'lsp'""")
def J12_three_way_match(spark, sf_dir):
    t = master(spark, sf_dir).groupBy("model", "seed").agg(*[F.avg(F.when(F.col("method") == m, F.col("accuracy"))).alias(m) for m in T.METHODS])
    grid = T.common_grid(matched(spark, sf_dir)).filter("status = 'main'").select("dataset", "target")
    return r6(grid.crossJoin(t).select("dataset", "target", "model", "seed", *T.METHODS))


@query(f"WITH {_MASTER} SELECT dataset, model, method, seed, run, accuracy, macro_f1, train_sec, artifact FROM ma ORDER BY dataset, model, method, run")
def C10_master_table(spark, sf_dir):
    """The whole sorted master table."""
    return master(spark, sf_dir).select("dataset", "model", "method", "seed", "run", "accuracy", "macro_f1", "train_sec", "artifact").orderBy("dataset", "model", "method", "run")


@query(f"WITH {_FRONTIER}{_NEAREST} SELECT dataset, method, target, run FROM nn WHERE abs_gap <= 0.005")
def C13_gap_manifest(spark, sf_dir):
    return matched(spark, sf_dir).filter("abs_gap <= 0.005").select("dataset", "method", "target", "run")


@query(f"""WITH {_FRONTIER}{_NEAREST}, al AS (SELECT *, CASE WHEN abs_gap > 0.005 THEN 'target_gap' WHEN run % 13 = 0 THEN 'saturated' ELSE 'accepted' END AS alone FROM nn)
SELECT dataset, method, target, run, CASE WHEN alone = 'accepted' AND count(*) FILTER (alone = 'accepted') OVER (PARTITION BY run) > 1 THEN 'artifact_matched_twice' ELSE alone END AS reason FROM al""")
def C13_manifest_reasons(spark, sf_dir):
    """Matched targets and why they may or may not enter the manifest; a thirteenth of the runs counts as saturated."""
    m = matched(spark, sf_dir).withColumn("saturated", F.col("run") % 13 == 0)
    return T.manifest_reasons(m, "run").select("dataset", "method", "target", "run", "reason")


@query(f"WITH {_MASTER} SELECT count(*) AS rows, count(DISTINCT run) AS runs, count(*) FILTER (accuracy IS NULL) AS missing FROM ma")
def C16_audit(spark, sf_dir):
    return master(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct("run").alias("runs"), F.count(F.when(F.col("accuracy").isNull(), 1)).alias("missing"))


@query(f"WITH {_MASTER} SELECT run, method, accuracy, NULL::DOUBLE AS epsilon FROM ma")
def P08_canonical_runs(spark, sf_dir):
    """Rows of JSON runs, typed: what a run lacks is null, what every run needs raises."""
    from lattica.sources.artifacts import canonical_runs

    path = scratch(spark, "json")
    master(spark, sf_dir).select("run", "method", "accuracy").write.json(path)
    read = spark.read.json(path)
    return canonical_runs(read, {"run": "bigint", "method": "string", "accuracy": "double", "epsilon": "double"}, ("run", "accuracy"))


@query(f"WITH {_MASTER} SELECT run FROM ma WHERE accuracy IS NULL OR isnan(accuracy) OR isinf(accuracy)")
def P10_require_finite(spark, sf_dir):
    from lattica.sources.artifacts import require_finite

    return require_finite(master(spark, sf_dir), ["accuracy"]).select("run")


@query(f"WITH {_MASTER} SELECT run FROM ma WHERE dataset = '1-URGENT' AND seed::VARCHAR = '3'")
def P13_string_filters(spark, sf_dir):
    from lattica.sources.artifacts import parse_filters

    out = master(spark, sf_dir)
    for name, value in parse_filters(["dataset=1-URGENT", "seed=3"]).items():
        out = out.filter(F.col(name).cast("string") == value)
    return out.select("run")


@query("WITH w AS (SELECT i::INT AS orbit, CASE WHEN i IN (3, 8, 9, 10, 11) THEN 0.0 ELSE 1.0 END::DOUBLE AS w FROM range(0, 15) t(i)) SELECT orbit, round(w * 15 / sum(w) OVER (), 6) AS w FROM w")
def W02_resolved_weights(spark, sf_dir):
    from lattica.sources.artifacts import resolve_weights

    return r6(resolve_weights(leave_orbits=[3, 8], leave_groups=["tailed_triangle"], normalize="mean_one").table(spark))
