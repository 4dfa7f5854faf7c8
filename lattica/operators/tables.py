"""Operators of the results warehouse: matching, roll-ups, splits and statistics over tables of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

METHODS = ("orbit_shift", "dspar", "lsp")
#: Largest gap between target and achieved reduction for a match to count as main, and as auxiliary.
MAIN_GAP, AUX_GAP = 0.015, 0.02


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate key values: an empty result means the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def nearest_target(rows: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """For each key and target the row whose value is nearest; then the least `ties`. Adds target and abs_gap.

    Targets are few and broadcast; the group-by keeps one row a key, target and
    task before it shuffles.
    """
    rest = [c for c in rows.columns if c not in keys]
    gap = F.abs(F.col(value) - F.col("target"))
    key = F.struct(gap.alias("abs_gap"), *[F.col(t).alias(f"t_{t}") for t in ties])
    best = rows.crossJoin(F.broadcast(targets)).groupBy(*keys, "target").agg(F.min_by(F.struct(*rest, gap.alias("abs_gap")), key).alias("r"))
    return best.select(*keys, "target", "r.*")


def common_grid(matched: DataFrame, main_gap: float = MAIN_GAP, aux_gap: float = AUX_GAP) -> DataFrame:
    """dataset, target, each method's achieved and abs_gap, the worst gap and its status."""
    cols = [F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in ("achieved", "abs_gap")]
    g = matched.groupBy("dataset", "target").agg(*cols)
    complete = F.lit(True)
    for m in METHODS:
        complete = complete & F.col(f"{m}_abs_gap").isNotNull()
    worst = F.greatest(*[F.col(f"{m}_abs_gap") for m in METHODS])
    status = F.when(complete & (worst <= main_gap), "main").when(complete & (worst <= aux_gap), "auxiliary").otherwise("unmatched")
    return g.withColumn("worst_gap", worst).withColumn("status", status)


def coverage(grid: DataFrame) -> DataFrame:
    """Targets by status and the mean worst gap of each dataset."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return grid.groupBy("dataset").agg(F.count("*").alias("targets"), n("main"), n("auxiliary"), n("unmatched"), F.avg("worst_gap").alias("mean_worst_gap"))


def training_manifest(grid: DataFrame) -> DataFrame:
    """The grid's methods as rows: dataset, target, status, method, achieved."""
    pairs = ", ".join(f"'{m}', {m}_achieved" for m in METHODS)
    return grid.selectExpr("dataset", "target", "status", f"stack({len(METHODS)}, {pairs}) as (method, achieved)").filter("achieved is not null")


def rollup(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Runs, and mean, median, sample deviation (null for one run), least and greatest of each metric."""
    aggs = [F.count("*").alias("runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"), F.stddev_samp(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return df.groupBy(*keys).agg(*aggs)


def method_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A mean for each method and metric side by side, and the first method's lead over the others."""
    aggs = [F.avg(F.when(F.col("method") == m, F.col(x))).alias(f"{m}_{x}") for m in METHODS for x in metrics]
    out = df.groupBy(*keys).agg(*aggs)
    for m in METHODS[1:]:
        for x in metrics:
            out = out.withColumn(f"{x}_lead_over_{m}", F.col(f"{METHODS[0]}_{x}") - F.col(f"{m}_{x}"))
    return out


def pairwise_summary(seed_means: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Wins, seeds, mean and sample deviation (0 for one seed) of the leads."""
    aggs = [F.count("*").alias("seeds")]
    for m in METHODS[1:]:
        c = f"{metric}_lead_over_{m}"
        aggs += [F.count(F.when(F.col(c) > 0, 1)).alias(f"wins_over_{m}"), F.avg(c).alias(f"mean_over_{m}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_over_{m}")]
    return seed_means.groupBy(*keys).agg(*aggs)


def runtime_ratios(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean runtimes by method, the first's difference from and ratio to each other; only groups with every method; a ratio to 0 is null."""
    out = df.groupBy(*keys).agg(*[F.avg(F.when(F.col("method") == m, F.col(metric))).alias(m) for m in METHODS])
    out = out.dropna(subset=list(METHODS))
    for m in METHODS[1:]:
        out = out.withColumn(f"delta_{m}", F.col(METHODS[0]) - F.col(m)).withColumn(f"ratio_{m}", F.expr(f"try_divide({METHODS[0]}, {m})"))
    return out


def amortised(df: DataFrame, artifact: str, runtime: str) -> DataFrame:
    """Adds how many rows use an artifact and its runtime divided by that."""
    n = F.count("*").over(W.partitionBy(artifact))
    return df.withColumn("uses", n).withColumn("amortised", F.col(runtime) / F.greatest(F.col("uses"), F.lit(1)))


def average_ranks(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the average rank of x. One global order; x's distinct values are what meets in a task, not rows."""
    counts = df.groupBy(x).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(x).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(x, (before + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, x)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the rank correlation of x and y with average ranks; null if either doesn't vary."""
    r = average_ranks(average_ranks(df.select(x, y), x, "__rx"), y, "__ry")
    return r.agg(F.when((F.stddev_pop("__rx") > 0) & (F.stddev_pop("__ry") > 0), F.corr("__rx", "__ry")).alias("rho"), F.count("*").alias("rows"))


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """MAE, RMSE and R2 of predictions; R2 is null where y doesn't vary."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.var_pop(y) > 0, 1 - F.avg(e * e) / F.var_pop(y)).alias("r2")
    )


def loglog_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Exponent, intercept and R2 of y against x in logarithms: positive pairs only, three of them at least."""
    ok = df.filter((F.col(x) > 0) & (F.col(y) > 0))
    lx, ly = F.ln(x), F.ln(y)
    out = ok.groupBy(*keys).agg(F.count("*").alias("points"), F.regr_slope(ly, lx).alias("exponent"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"))
    return out.filter("points >= 3")


def coefficient_stability(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, median, share of nonzeros (beyond 1e-12) and their sign consistency."""
    c = F.col(value)
    pos, neg, non = (F.count(F.when(x, 1)) for x in (c > 1e-12, c < -1e-12, F.abs(c) > 1e-12))
    return df.groupBy(*keys).agg(
        F.count("*").alias("folds"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.median(c).alias("median"), (non / F.count("*")).alias("nonzero_fraction"),
        F.when(non > 0, F.greatest(pos, neg) / non).otherwise(0.0).alias("sign_consistency"),
    )


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy and macro-F1 over the classes in y or p."""
    m = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    side = lambda c: m.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(f"n_{c}"))
    hit = m.filter("y = p").select(F.col("y").alias("k"), F.col("n").alias("tp"))
    j = side("y").join(side("p"), "k", "full_outer").join(hit, "k", "left").fillna(0)
    f1 = F.when(F.col("n_y") + F.col("n_p") > 0, 2 * F.col("tp") / (F.col("n_y") + F.col("n_p"))).otherwise(0.0)
    return j.agg((F.sum("tp") / F.sum("n_y")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def manifest_reasons(matched: DataFrame, artifact: str, gap: float = 0.005) -> DataFrame:
    """Adds reason: why a matched target (target, abs_gap, saturated) can't enter a manifest, or `accepted`.

    An artifact that serves several targets, each else acceptable, is accepted for none.
    """
    alone = F.when(F.col("abs_gap") > gap, "target_gap").when(F.col("saturated"), "saturated").otherwise("accepted")
    n = F.count(F.when(F.col("reason") == "accepted", 1)).over(W.partitionBy(artifact))
    out = matched.withColumn("reason", alone).withColumn("__n", n)
    return out.withColumn("reason", F.when((F.col("reason") == "accepted") & (F.col("__n") > 1), "artifact_matched_twice").otherwise(F.col("reason"))).drop("__n")


def folds(df: DataFrame, artifact: str, n: int) -> DataFrame:
    """Each artifact and its fold: sorted artifacts dealt in turn."""
    ids = df.select(artifact).distinct()
    return ids.select(artifact, ((F.row_number().over(W.orderBy(artifact)) - 1) % n).alias("fold"))


def held_out_splits(df: DataFrame, by: str, artifact: str, n: int) -> DataFrame:
    """value, fold, role, rows: each value's own artifacts, sorted, are dealt in turn to n folds (as many as it has, if fewer).

    Test rows have the value and one of the fold's artifacts; train rows have
    another value and none of the fold's artifacts.
    """
    counts = df.groupBy(F.col(by).alias("of"), F.col(artifact).alias("artifact")).agg(F.count("*").alias("rows"))  # rows meet splits as counts
    own = counts.select(F.col("of").alias("value"), "artifact")
    place = F.row_number().over(W.partitionBy("value").orderBy("artifact")) - 1
    held = own.withColumn("fold", (place % F.least(F.lit(n), F.count("*").over(W.partitionBy("value")))).cast("int"))
    test = held.join(counts.withColumnRenamed("of", "value"), ["value", "artifact"]).groupBy("value", "fold").agg(F.sum("rows").alias("rows"))
    splits = held.select("value", "fold").distinct()
    other = counts.groupBy("of").agg(F.sum("rows").alias("all"))
    rest = splits.join(F.broadcast(other), F.col("of") != F.col("value")).groupBy("value", "fold").agg(F.sum("all").alias("all"))
    shared = held.join(counts, "artifact").filter("of <> value").groupBy("value", "fold").agg(F.sum("rows").alias("shared"))
    train = rest.join(shared, ["value", "fold"], "left").select("value", "fold", (F.col("all") - F.coalesce("shared", F.lit(0))).alias("rows"))
    out = test.withColumn("role", F.lit("test")).unionByName(train.withColumn("role", F.lit("train")))
    return out.filter("rows > 0").select("value", "fold", "role", "rows")


def validated_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join of many to one; a key that stands twice on the right is an error when the result is read."""
    n = F.col("__n")
    once = F.when(n > 1, F.raise_error(F.lit("a key of the right side isn't unique")).cast("long")).otherwise(n)
    counted = right.groupBy(*on).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in on])
    return left.join(counted.withColumn("__n", once), list(on), "left").filter("__n is null or __n = 1").drop("__n")


def none_safe_order(numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> list[Column]:
    """Sort keys in which a null number counts as -1 and a null text as empty."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numbers] + [F.coalesce(F.col(c), F.lit("")) for c in texts]


def checkpoint_targets(edges: int, target: float, requested: Sequence[float]) -> list[tuple[int, list[float]]]:
    """(removed edges, rhos) of checkpoints: 0, the target and what is requested up to it, equal counts together."""
    of: dict[int, set[float]] = {}
    for rho in {0.0, target, *(r for r in requested if r <= target + 1e-15)}:
        of.setdefault(round(edges * rho), set()).add(rho)
    return [(n, sorted(of[n])) for n in sorted(of)]


def derive_weights(df: DataFrame, value: str, filters: dict[str, str] | None = None, transform: str = "positive", aggregation: str = "mean", floor: float = 0.0) -> DataFrame:
    """orbit and w from a table of coefficients by `feature` (orbit_<k>_...): filtered, transformed, aggregated, floored where positive."""
    for name, v in (filters or {}).items():
        df = df.filter(F.col(name).cast("string") == v)
    c = F.col(value)
    t: Column = {"positive": F.greatest(c, F.lit(0.0)), "absolute": F.abs(c), "softplus": F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))}[transform]
    orbit = F.regexp_extract("feature", r"^orbit_(\d+)_", 1)
    agg = F.avg(t) if aggregation == "mean" else F.median(t)
    w = df.filter(orbit != "").groupBy(orbit.cast("int").alias("orbit")).agg(agg.alias("w"))
    return w.withColumn("w", F.when(F.col("w") > 0, F.greatest("w", F.lit(floor))).otherwise(F.col("w")))
