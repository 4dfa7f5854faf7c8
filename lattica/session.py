"""Session helpers: table access and tables materialised in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own; a
    cluster has to name one, as a machine-local folder would lose rows there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, grouped by application so it can be removed as one."""
    return f"{shared_dir(spark)}/lattica-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Writes df as parquet in the shared folder and reads it back.

    Cuts lineage in a way that outlives lost executors: later stages read files
    that every machine sees.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of more rows than this are joined by shuffling, however small their files are.
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`materialize` for tables that compress to far less than their rows take.

    The planner goes by the files' bytes: 18 million orbit counts take 5 MB, and
    would be broadcast through the driver where they'd take a gigabyte.
    """
    out = materialize(df, name)
    return out.hint("merge") if out.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files behind frames that `materialize` made and nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
