"""First-seen selection over a stream of files: each batch against what was accepted before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import content_key
from corpusmill.operators.dedup import first_of
from corpusmill.operators.splits import hash_split
from corpusmill.session import shared_dir, temporary


class Accepted:
    """Table of accepted contents: (key, id, split, size, batch), one folder a batch. A batch that is
    delivered again overwrites its own folder, so a restart after a failure changes nothing."""

    SCHEMA = "key string, id bigint, split int, size bigint, batch bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.spark.createDataFrame([], self.SCHEMA).write.mode("ignore").partitionBy("batch").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, rows: DataFrame, batch: int) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def select_batch(rows: DataFrame, accepted: Accepted, batch: int, targets: dict[int, int], buckets: int = 2048) -> None:
    """Accept the first row of each content that no earlier batch accepted, by split, until a split's
    target of characters is reached. rows: (id, text). Null texts are ignored. A split is filled in
    the order of ids; a batch is a file set of bounded size, the table of accepted keys is not held."""
    from corpusmill.operators.ordered import running

    before = accepted.read().where(F.col("batch") != batch)
    keyed = rows.where("text is not null").select("id", content_key(F.col("text")).alias("key"), F.length("text").cast("bigint").alias("size"))
    new = first_of(keyed, ["key"], "id").join(before.select("key"), "key", "left_anti").withColumn("split", hash_split(F.col("key"), buckets))
    full = {r[0]: r[1] for r in before.groupBy("split").agg(F.sum("size")).collect()}  # one row a split
    left = F.create_map(*(F.lit(int(x)) for k, v in targets.items() for x in (k, v - full.get(k, 0))))
    kept = running(new, ["id"], {"_t": F.col("size")}, ["split"]).where(F.col("_t") - F.col("size") < F.element_at(left, F.col("split")))
    accepted.add(kept.select("key", "id", "split", "size"), batch)


def run(spark: SparkSession, source: str, schema: str, id: str, text: str, targets: dict[int, int], path: str | None = None, buckets: int = 2048, files: int = 1) -> DataFrame:
    """Consume the Parquet files under `source` that are there now, a few at a time, and return the
    accepted table. Progress is in the checkpoint beside it: a second run takes only new files."""
    path = path or temporary(spark, f"{shared_dir(spark)}/corpusmill/accepted-{uuid.uuid4().hex}")
    accepted = Accepted(spark, path + "/table")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a table in one file
        reader, source = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    stream = reader.parquet(source)
    stream = stream.select(F.col(id).alias("id"), F.col(text).alias("text"))
    q = stream.writeStream.foreachBatch(lambda rows, n: select_batch(rows, accepted, n, targets, buckets)).option("checkpointLocation", path + "/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return accepted.read()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and hour of a stream with late rows: an addition for monitoring, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
