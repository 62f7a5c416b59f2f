"""Structured Streaming over event tables; each has a batch equivalent with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.shared import WRITTEN


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream, its ts with a time zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one = spark.readStream.schema(schema).option("pathGlobFilter", name) if not _is_folder(spark, path) else spark.readStream.schema(schema)
    return one.parquet(folder if not _is_folder(spark, path) else path).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_of_each(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first event of each key: a request that comes twice within the watermark is refused the second time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, folder: str, mode: str = "complete", name: str | None = None) -> DataFrame:
    """All that is there and new goes through the stream once; the result is read from the folder, which all executors share.

    With a name, state and result are those of earlier runs of that name, gone
    on with. A batch is written to a folder of its own number, so one that is
    tried again writes nothing twice. `shared.clean` deletes what unnamed runs leave.
    """
    spark = stream.sparkSession
    out = f"{folder.rstrip('/')}/stream-{name or uuid.uuid4().hex}"
    if name is None:
        WRITTEN.extend((out, f"{out}-state"))
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/none")
    query.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
