"""Controlled regressions with grouped splits, importance by permutation, bootstrapped rank correlation, and node classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import bidirectional, degrees

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def moments(df: DataFrame, columns: list[str], target: str) -> tuple[int, np.ndarray]:
    """Row count and the matrix of sums of products of (1, columns, target): all that least squares needs, whatever the rows' number."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(target).cast("double")]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*[F.coalesce(F.sum(names[i] * names[j]), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(names), len(names)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"s{i}_{j}"]
    return int(m[0, 0]), m


def ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients on columns scaled to population deviation 1, given back for raw columns; from `moments`."""
    n = max(m[0, 0], 1.0)
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    sd[sd < 1e-12] = 1.0
    a = cov[1:-1, 1:-1] / np.outer(sd, sd) + np.eye(len(sd)) * alpha / n
    beta = np.linalg.solve(a, cov[1:-1, -1] / sd) / sd
    return np.concatenate([[mean[-1] - beta @ mean[1:-1]], beta])


def predicted(columns: list[str], beta: np.ndarray):
    out = F.lit(float(beta[0]))
    for c, b in zip(columns, beta[1:]):
        out = out + F.col(c).cast("double") * F.lit(float(b))
    return out


def grouped_ridge(train: DataFrame, columns: list[str], target: str, group: str, folds: int = 3, alphas: tuple[float, ...] = ALPHAS) -> tuple[float, np.ndarray]:
    """The penalty with the least mean absolute error over grouped folds, and the coefficients on all of train."""
    fold = F.pmod(F.xxhash64(group), F.lit(folds))
    parts = [moments(train.filter(fold == f), columns, target)[1] for f in range(folds)]
    whole = sum(parts)
    fits = [(a, f, ridge(whole - parts[f], a)) for a in alphas for f in range(folds)]
    errors = [F.avg(F.when(fold == f, F.abs(F.col(target) - predicted(columns, b)))).alias(f"e{k}") for k, (_, f, b) in enumerate(fits)]
    row = train.agg(*errors).first()
    mean = {a: np.mean([row[f"e{k}"] for k, (x, _, _) in enumerate(fits) if x == a and row[f"e{k}"] is not None]) for a in alphas}
    best = min(alphas, key=lambda a: (mean[a], a))
    return best, ridge(whole, best)


def one_hot(df: DataFrame, column: str, values: list[str]) -> tuple[DataFrame, list[str]]:
    """Every level as a 0/1 column; an unknown one is all zeros."""
    names = [f"{column}_{k}" for k in range(len(values))]
    return df.withColumns({n: (F.col(column) == v).cast("double") for n, v in zip(names, values)}), names


def permutation_importance(test: DataFrame, columns: list[str], beta: np.ndarray, target: str, group: str, repeats: int = 32, seed: int = 0) -> DataFrame:
    """feature, repeat, increase: the rise of the mean absolute error when a feature's values are dealt over groups anew.

    A group's value is its mean; groups take the value of the next group in a
    seeded order, so all rows of a group move together.
    """
    from pyspark.sql import Window as W

    base = test.agg(F.avg(F.abs(F.col(target) - predicted(columns, beta))).alias("base"))
    means = test.groupBy(group).agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    # a row a group and repeat: groups are artifacts, not rows
    many = means.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = W.partitionBy("repeat").orderBy(F.xxhash64(F.lit(seed) + F.col("repeat"), group))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = many.select(group, "repeat", *[F.coalesce(F.lag(f"m_{c}").over(order), F.last(f"m_{c}").over(whole)).alias(f"p_{c}") for c in columns])
    errors = [F.avg(F.abs(F.col(target) - (predicted(columns, beta) + (F.col(f"p_{c}") - F.col(c)) * F.lit(float(b))))).alias(c) for c, b in zip(columns, beta[1:])]
    e = test.join(nxt, group).groupBy("repeat").agg(*errors).crossJoin(base)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col("base")).alias("increase")) for c in columns]))
    return e.select(rows.alias("x"), "repeat").select("x.*", "repeat")


def bootstrap_spearman(df: DataFrame, x: str, y: str, group: str, repeats: int = 200, seed: int = 0) -> DataFrame:
    """One row: rank correlation, and its 2.5 and 97.5 % quantiles over resamples of whole groups.

    A group's copies in a resample come from a Poisson number of mean 1 by
    seeded hash, so that no list of groups is gathered.
    """
    from pyspark.sql import Window as W

    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col(group)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    cdf, p = [], float(np.exp(-1))
    for k in range(8):
        cdf.append((cdf[-1] if cdf else 0.0) + p)
        p /= k + 1
    copies = sum((F.when(u > c, 1).otherwise(0) for c in cdf[1:]), F.when(u > cdf[0], 1).otherwise(0))
    reps = df.select(x, y, group, F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("rep"))
    w = reps.withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(copies)).filter("w > 0")

    def ranked(d: DataFrame, c: str, name: str) -> DataFrame:
        n = d.groupBy("rep", c).agg(F.sum("w").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("rep").orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return d.join(n.select("rep", c, (before + (F.col("n") + 1) / 2).alias(name)), ["rep", c])

    r = ranked(ranked(w, x, "rx"), y, "ry")
    s = {k: F.sum(F.col("w") * e) for k, e in {"n": F.lit(1.0), "x": F.col("rx"), "y": F.col("ry"), "xx": F.col("rx") * F.col("rx"), "yy": F.col("ry") * F.col("ry"), "xy": F.col("rx") * F.col("ry")}.items()}
    sums = r.groupBy("rep").agg(*[v.alias(k) for k, v in s.items()])
    rho = F.expr("try_divide(xy - x * y / n, sqrt((xx - x * x / n) * (yy - y * y / n)))")
    per = sums.select("rep", rho.alias("rho"))
    return per.agg(
        F.max(F.when(F.col("rep") == 0, F.col("rho"))).alias("rho"),
        F.percentile(F.when(F.col("rep") > 0, F.col("rho")), F.lit(0.025)).alias("low"),
        F.percentile(F.when(F.col("rep") > 0, F.col("rho")), F.lit(0.975)).alias("high"),
    )


def propagate(edges: DataFrame, features: DataFrame, nodes: DataFrame, kind: str, columns: list[str], weight: str | None = None) -> DataFrame:
    """One step of a graph convolution (`gcn`: symmetric norm with self-loops) or of a mean over neighbours (`sage`), as joins."""
    f = features.select(F.col("node").alias("v"), *columns)
    two = bidirectional(edges.select("u", "v", *([weight] if weight else [])))
    if kind == "sage":
        w = F.col(weight) if weight else F.lit(1.0)
        h = two.join(f, "v").groupBy(F.col("u").alias("node")).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"n_{c}") for c in columns])
        return features.join(h, "node", "left").fillna(0.0, [f"n_{c}" for c in columns])
    if kind != "gcn" or weight:
        raise ValueError("gcn without weights, or sage")
    d = degrees(nodes, edges)
    loops = nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))
    j = two.unionByName(loops).join(f, "v").join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    norm = F.sqrt((F.col("du") + 1) * (F.col("dv") + 1))
    return j.groupBy(F.col("u").alias("node")).agg(*[F.sum(F.col(c) / norm).alias(c) for c in columns])


def train_and_evaluate(features: DataFrame, columns: list[str], split: str = "split", label: str = "label", steps: int = 100):
    """node, label and prediction of a multinomial logistic classifier on (propagated) features, fitted on split `train`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep").transform(features.withColumn("__y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=steps, regParam=1e-3, family="multinomial").fit(data.filter(F.col(split) == "train"))
    return model.transform(data).select("node", F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), split)
