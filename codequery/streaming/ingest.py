"""Continuous ingestion: new files of a folder become units as they come. An extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files as source_files

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_a_batch: int = 1_000) -> DataFrame:
    """Units of files as they appear; stateless, so a restart goes on from the checkpoint."""
    found = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return source_files.parse(source_files.relative(found, folder).select("path", "length", "content"))


def append(units: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each batch under its own number: a batch that is tried again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("batch", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    started = units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """Units of each file's latest batch: later batches replace a file's units as a whole."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi")
