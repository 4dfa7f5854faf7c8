"""Configurations, run artifacts and weight specifications: small files on the driver, tables in parquet."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.orbits import GROUPS, ORBITS

WEIGHT_SCHEMA = "lattica-orbit-weights-1"


def _known(cls, raw: dict[str, Any]):
    """An instance of cls; keys it doesn't know go to `options`."""
    names = {f.name for f in fields(cls)} - {"options"}
    own = {k: v for k, v in raw.items() if k in names}
    rest = {k: v for k, v in raw.items() if k not in names and k != "options"}
    return cls(**own, options={**raw.get("options", {}), **rest})


@dataclass
class DatasetConfig:
    name: str = "gp"
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class PruningConfig:
    method: str = "orbit_shift"
    target_rho: float = 0.3
    recompute_rounds: float = 1
    score_mode: str = "relative"
    d_min: int = 2
    guard_bridges: bool = False
    eps: float = 1e-8
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        self.recompute_rounds = max(1, math.ceil(self.recompute_rounds))
        if not 0 <= self.target_rho <= 1:
            raise ValueError("target_rho has to be within 0 and 1")


@dataclass
class ModelConfig:
    name: str = "gcn"
    max_epochs: int = 300
    options: dict[str, Any] = field(default_factory=dict)


CONFIGS = {"dataset": DatasetConfig, "pruning": PruningConfig, "model": ModelConfig}


def load_config(text: str) -> dict[str, Any]:
    """Typed configurations from YAML (or JSON) text whose top level has to be a mapping."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("the top level has to be a mapping")
    return {k: _known(CONFIGS[k], v) if k in CONFIGS else v for k, v in raw.items()}


def resolved(config: dict[str, Any], seed: int) -> str:
    """A snapshot of configurations as JSON with sorted keys."""
    return json.dumps({**{k: asdict(v) if hasattr(v, "__dataclass_fields__") else v for k, v in config.items()}, "seed": seed}, sort_keys=True, indent=2)


def parse_float_sets(items: list[str], defaults: dict[str, list[float]] | None = None) -> dict[str, list[float]]:
    """`dataset:r1,r2` overrides over defaults; names in lower case."""
    out = {k.lower(): list(v) for k, v in (defaults or {}).items()}
    for item in items:
        name, _, values = item.partition(":")
        if not values:
            raise ValueError(f"{item!r} isn't dataset:r1,r2")
        out[name.strip().lower()] = [float(x) for x in values.split(",")]
    return out


def parse_filters(items: list[str]) -> dict[str, str]:
    """`key=value` filters."""
    if any("=" not in i for i in items):
        raise ValueError("filters are key=value")
    return dict(i.split("=", 1) for i in items)


@dataclass(frozen=True)
class OrbitWeights:
    """Fifteen finite weights of 0 or more, not all 0."""

    weights: tuple[float, ...]
    source: str = "inline"

    def __post_init__(self):
        if len(self.weights) != ORBITS or any(not math.isfinite(w) or w < 0 for w in self.weights) or sum(self.weights) <= 0:
            raise ValueError("15 finite weights of 0 or more, with a positive sum")

    def fingerprint(self) -> str:
        """SHA-256 of the weights alone, whatever they came from."""
        return hashlib.sha256(json.dumps([float(w) for w in self.weights]).encode()).hexdigest()

    def normalized(self, how: str) -> OrbitWeights:
        factor = {"none": 1.0, "sum_one": 1 / sum(self.weights), "mean_one": ORBITS / sum(self.weights)}[how]
        return OrbitWeights(tuple(w * factor for w in self.weights), self.source)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(w)) for k, w in enumerate(self.weights)], "orbit int, w double")

    def dump(self) -> str:
        return json.dumps({"schema": WEIGHT_SCHEMA, "dimension": ORBITS, "weights": list(self.weights), "source": self.source, "fingerprint": self.fingerprint()}, sort_keys=True, indent=2)

    @staticmethod
    def load(text: str) -> OrbitWeights:
        raw = json.loads(text)
        if raw.get("schema") != WEIGHT_SCHEMA or raw.get("dimension") != ORBITS:
            raise ValueError("not a weight specification of this schema")
        out = OrbitWeights(tuple(raw["weights"]), raw.get("source", "file"))
        if raw.get("fingerprint", out.fingerprint()) != out.fingerprint():
            raise ValueError("fingerprint differs")
        return out


def resolve_weights(inline: list[float] | None = None, text: str | None = None, leave_orbits: list[int] = (), leave_groups: list[str] = (), normalize: str = "none") -> OrbitWeights:
    """Inline weights or a specification, not both; the union of left-out orbits and groups is set to 0, then normed."""
    if inline is not None and text is not None:
        raise ValueError("inline weights or a specification, not both")
    base = OrbitWeights.load(text).weights if text is not None else tuple(inline or [1.0] * ORBITS)
    gone = set(leave_orbits) | {o for g in leave_groups for o in GROUPS[g]}
    return OrbitWeights(tuple(0.0 if k in gone else w for k, w in enumerate(base)), "resolved").normalized(normalize)


def write_graph_text(spark: SparkSession, nodes: int, edges: DataFrame, path: str) -> None:
    """The counting tools' format: a line with the numbers of nodes and edges, then `u v` a line, in order. One file."""
    n = edges.count()
    head = spark.createDataFrame([(-1, -1, f"{nodes} {n}")], "u long, v long, value string")
    body = edges.select("u", "v", F.concat_ws(" ", "u", "v").alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("u", "v").select("value").write.text(path)


def read_counts_text(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    """node and o0 to o14 from one line of counts a node; another number of lines is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("node", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    out = lines.select(F.col("node").cast("long").alias("node"), *[parts[k].cast("long").alias(f"o{k}") for k in range(ORBITS)])
    if out.count() != nodes:
        raise ValueError("another number of rows than nodes")
    return out


def write_runs(rows: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "method")) -> None:
    """Run rows in parquet, a folder for each value of `by`; added to what is there."""
    rows.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


def read_json_runs(spark: SparkSession, root: str) -> DataFrame:
    """metrics.json of every run below `root` with its folder; no run is an error."""
    out = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").option("multiLine", True).json(root)
    out = out.withColumn("run_dir", F.regexp_replace("_metadata.file_path", "/metrics.json$", ""))
    if not out.limit(1).count():
        raise FileNotFoundError(f"no metrics.json below {root}")
    return out


def canonical_runs(metrics: DataFrame, columns: dict[str, str], required: tuple[str, ...]) -> DataFrame:
    """Columns of canonical run rows by name and type: absent or unreadable values are null, but raise where required."""
    out = []
    for name, kind in columns.items():
        c = F.expr(f"try_cast(nullif(cast(`{name}` as string), '') as {kind})") if name in metrics.columns else F.lit(None).cast(kind)
        if name == "method":
            c = F.coalesce(c, F.lit("dense"))
        if kind == "double":
            c = F.nanvl(c, F.lit(None).cast("double"))
        if name in required:
            c = F.coalesce(c, F.raise_error(F.lit(f"{name} is missing")).cast(kind))
        out.append(c.alias(name))
    return metrics.select(*out)


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null, NaN or infinite value in one of the columns: none if df is fit for statistics."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.filter(bad)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, listed: DataFrame, path: str) -> DataFrame:
    """Records whose file is gone or differs."""
    now = manifest(spark, path).toDF("path", "bytes_now", "sha256_now")
    return listed.join(now, "path", "left").filter(~(F.col("bytes").eqNullSafe(F.col("bytes_now")) & F.col("sha256").eqNullSafe(F.col("sha256_now"))))


def artifact_id(checkpoint: DataFrame, dataset: str) -> DataFrame:
    """One row: 24 hexadecimal digits of SHA-256 over a dataset's checkpoint table, free of paths."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("orbit", "current_total", "abs_delta"))), lambda r: F.concat_ws(",", r["orbit"], r["current_total"], r["abs_delta"]))
    return checkpoint.agg(F.substring(F.sha2(F.concat(F.lit(f"{dataset}|"), F.array_join(parts, ";")), 256), 1, 24).alias("artifact_id"))
