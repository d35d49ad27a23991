"""What the corpus operators share: table access, tables written in shared storage, samples, folds."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What Python gets at a time: so many rows, or the rows that reach so many bytes (one longer text goes alone).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's Arrow batches are bounded by BATCH_ROWS and BATCH_BYTES from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return spark.conf.get("spark.codequery.ownCheckpointDir", None) or _own_dir(spark)


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="codequery-checkpoint-")
    spark.conf.set("spark.codequery.ownCheckpointDir", made)
    return made


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder: this cuts the lineage.

    The folder goes when the driver ends, or earlier by dropped(); the shuffles that made the rows go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def unused(name: str, df: DataFrame) -> str:
    """The name, with underscores behind it until no column of the frame has it."""
    while name in df.columns:
        name += "_"
    return name


def sampled(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """At most size rows: of those that differ in the columns named, the ones with the least hash of these.

    A cut-off by hash comes first, so that what partitions send on is bounded by size and not by their number.
    """
    share = min(1.0, (1.2 * size + 200) / max(1, rows.count()))
    h = unused("_h", rows)
    few = rows.withColumn(h, F.xxhash64(*by)).where(F.col(h) <= F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64))))
    return few.groupBy(h).agg(*[F.first(c).alias(c) for c in rows.columns]).orderBy(h).limit(size).drop(h)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def on_table(f, *first):
    """f(*first, table) -> table, hinted as applyInArrow wants it."""

    def call(rows):
        return f(*first, rows)

    call.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    return call


def on_tables(f, *first):
    """The same for a pair of cogrouped tables."""

    def call(left, right):
        return f(*first, left, right)

    call.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return call
