"""JSON in and out: training pairs as lines, labelled question sets and reports as one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "repository string, split string, queries array<struct<id:string,query:string,relevant:array<string>>>"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row a line; a line that is no JSON of the schema ends the job, as training data must be whole."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query, text) and (query, label) of a labelled question set."""
    each = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).select(F.inline("queries"))
    return each.select(F.col("id").alias("query"), F.col("query").alias("text")), each.select(F.col("id").alias("query"), F.explode("relevant").alias("label"))


def safe(value) -> object:
    """F.to_json of a struct or map: metadata as text that any store takes."""
    return F.to_json(value)
