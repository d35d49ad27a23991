"""The corpus pipeline: quality, language, repeated lines, near-duplicate documents, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequery.llm import op4_quality_classifier as op4
from codequery.llm import op6_line_dedup as op6
from codequery.llm import op7_language_id as op7
from codequery.llm import op8_simhash_near_dedup as op8
from codequery.llm import op10_best_fit_packing as op10
from codequery.llm.common import stored, table

STAGES = [
    ("quality classifier", op4.stage),
    ("language ID", op7.stage),
    ("line dedup", op6.stage),
    ("SimHash near-dedup", op8.stage),
    ("best-fit packing", op10.stage),
]

#: The trained stages and XXH64 are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again by the next.

    The folders go when the driver ends. An empty table, null texts and ties pass as each stage's docstring says.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
