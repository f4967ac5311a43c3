"""Session defaults, and places that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "corpusmill", cpus: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    own = DEFAULTS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=own | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, and a temporary one only
    where that setting is absent and the session runs on this machine alone."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    own = spark.conf.get("corpusmill.local.dir", None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set("corpusmill.local.dir", own)
    return own


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of one file is else one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by materialize(); a missing one is no error."""
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def temporary(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when the driver's JVM ends, also if the session was stopped before."""
    fs, p = filesystem(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and the
    loss of an executor repeats only what reads the files. Removed when the driver's JVM ends, or
    before by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(temporary(spark, path))
    out._table = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_table", None):
            remove(t.sparkSession, t._table)
            t._table = None
