"""Stored graphs and runs: pruned-graph artifacts, score tables, JSON documents, run folders and a cache of orbit counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.orbits import gdv_closed
from lattica.session import shared_dir


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """One JSON document in a file at `path`, indented by two, keys sorted; an existing file is replaced."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(payload, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """The document at `path`; anything but an object is an error."""
    rows = spark.read.text(path, wholetext=True).collect()
    payload = json.loads(rows[0]["value"]) if rows else None
    if not isinstance(payload, dict):
        raise ValueError(f"{path} holds no JSON object")
    return payload


def write_rows_json(rows: DataFrame, path: str) -> None:
    """`{"rows": [...]}` in one document, nulls kept: for result tables, whose rows are few."""
    packed = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
    doc = packed.agg(F.concat(F.lit('{"rows":['), F.array_join(F.sort_array(F.collect_list("r")), ","), F.lit("]}")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_rows_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a `{"rows": [...]}` document, typed."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"rows array<struct<{schema}>>").alias("d"))
    return doc.select(F.explode("d.rows").alias("r")).select("r.*")


def write_pruned_graph(path: str, nodes: DataFrame, kept: DataFrame, removed: DataFrame, config: dict, weight: str | None = None) -> None:
    """A pruned graph as folders nodes, edges and removed, and config.json with the counts.

    `kept` has u, v and, where given, a column of weights; nodes keep all columns.
    """
    spark = kept.sparkSession
    edges = kept.select("u", "v", (F.col(weight) if weight else F.lit(None)).cast("double").alias("weight"))
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    removed.select("u", "v").write.mode("overwrite").parquet(f"{path}/removed")
    n = {k: spark.read.parquet(f"{path}/{k}").count() for k in ("nodes", "edges", "removed")}
    write_json(spark, f"{path}/config.json", config | {"counts": n, "weighted": weight is not None})


def load_pruned_graph(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """config, nodes, edges (u, v, weight) and removed edges of a stored graph; counts that differ from config.json are an error."""
    config = read_json(spark, f"{path}/config.json")
    parts = [spark.read.parquet(f"{path}/{k}") for k in ("nodes", "edges", "removed")]
    for k, df in zip(("nodes", "edges", "removed"), parts):
        if df.count() != config["counts"][k]:
            raise ValueError(f"{path}/{k} hasn't the rows that its config names")
    return config, *parts


def edge_digest(nodes: int, edges: DataFrame) -> str:
    """A key of a graph's content, whatever the order of its edges: counts and two independent sums of hashes, added up where the edges are."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")).alias(f"s{seed}")
    r = edges.agg(F.count("*").alias("n"), total(1), total(2)).first()
    return f"{nodes}-{r['n']}-{int(r['s1'] or 0) & (1 << 80) - 1:x}-{int(r['s2'] or 0) & (1 << 80) - 1:x}"


def cached_gdv(nodes: DataFrame, edges: DataFrame, namespace: str, root: str | None = None) -> tuple[DataFrame, dict]:
    """Orbit counts of a graph, from the cache below `root` if a graph of the same content is in it, and what was done.

    A folder counts once its writing is committed; one left by a job that was
    lost is written anew.
    """
    spark = edges.sparkSession
    key = edge_digest(nodes.count(), edges)
    path = f"{root or shared_dir(spark) + '/gdv-cache'}/{namespace}/{key}"
    hit = exists(spark, f"{path}/_SUCCESS")
    if not hit:
        gdv_closed(nodes, edges).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), {"key": key, "hit": hit, "path": path}


def load_runs(spark: SparkSession, root: str, metrics: str, config: str) -> DataFrame:
    """A row for each folder below `root` with a metrics.json: run_dir, its metrics and config, and whether it has a config.

    `metrics` and `config` are the schemas that are read. No run is an error.
    """

    def documents(name: str, schema: str, alias: str) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).schema(schema).json(root)
        return read.select(F.regexp_replace(F.col("_metadata.file_path"), f"/{name}$", "").alias("run_dir"), F.struct("*").alias(alias))

    found = documents("metrics.json", metrics, "metrics")
    if found.isEmpty():
        raise FileNotFoundError(f"no metrics.json below {root}")
    out = found.join(documents("config.json", config, "config"), "run_dir", "left")
    return out.withColumn("has_config", F.col("config").isNotNull())


def registry_faults(registry: DataFrame) -> DataFrame:
    """rule and subject of what is wrong with a table of orbits (orbit, size, edges, multiplicity, role_degree): no row if it is sound.

    Ids run from 0 without gaps; the orbits of a graphlet have as many nodes as
    it; their degrees add up to twice its edges. Orbits of one graphlet share
    size and edges and follow one another; a new graphlet begins where the nodes
    so far are as many as its size.
    """
    from pyspark.sql import Window as W

    ids = registry.agg(F.count("*").alias("n"), F.count_distinct("orbit").alias("d"), F.min("orbit").alias("low"), F.max("orbit").alias("high"))
    gaps = ids.filter("n <> d or low <> 0 or high <> n - 1").select(F.lit("contiguous_ids").alias("rule"), F.lit(None).cast("int").alias("subject"))
    # a fixed table of 15 rows
    before = F.sum("multiplicity").over(W.partitionBy("size", "edges").orderBy("orbit").rowsBetween(W.unboundedPreceding, -1))
    placed = registry.withColumn("graphlet", F.floor(F.coalesce(before, F.lit(0)) / F.col("size")))
    per = placed.groupBy("size", "edges", "graphlet").agg(F.min("orbit").alias("subject"), F.sum("multiplicity").alias("held"), F.sum(F.col("multiplicity") * F.col("role_degree")).alias("ends"))
    nodes = per.filter("held <> size").select(F.lit("nodes_of_graphlet").alias("rule"), "subject")
    ends = per.filter("ends <> 2 * edges").select(F.lit("handshake").alias("rule"), "subject")
    return gaps.unionByName(nodes).unionByName(ends)
