"""Graphs derived from tables: nodes(node, label) and canonical edges(u, v) with u < v."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.graph import canonical_edges
from lattica.session import table

#: Least quantity of a returned line for it to join its part to the order's other parts.
QUANTITY = {"gp": 25, "gs": 40}


def co_returned(spark: SparkSession, sf_dir: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Parts as nodes; an edge where one order returned both, each in at least `least` pieces.

    Lines of an order are few, so the self-join on the order has no hot key.
    """
    lines = table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= least))
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("u"))
    b = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("v"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label"))
    return nodes, canonical_edges(a.join(b, "o").select("u", "v"))


def ring(spark: SparkSession, n: int, steps: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Edges of n nodes in a ring, each joined to those `steps` ahead."""
    ahead = spark.range(n).select(F.col("id").alias("u"), F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    return canonical_edges(ahead.select("u", ((F.col("u") + F.col("step")) % n).alias("v")))


def star(spark: SparkSession, n: int) -> DataFrame:
    """Edges from node 0 to all others."""
    return spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))


#: Graphs by name; each takes (spark, sf_dir) and gives nodes and edges.
DATASETS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {
    "gp": lambda spark, sf_dir: co_returned(spark, sf_dir, QUANTITY["gp"]),
    "gs": lambda spark, sf_dir: co_returned(spark, sf_dir, QUANTITY["gs"]),
}


def load_graph(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a registered graph; other names are an error."""
    if name not in DATASETS:
        raise ValueError(f"unknown graph {name!r}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, sf_dir)
