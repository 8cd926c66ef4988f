"""Corpus pipeline: documents through quality rules, line deduplication, near-duplicate removal, personal data and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's documents. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm.line_windows import line_windows_stage
from kinmatch.llm.near_duplicates import near_duplicates_stage
from kinmatch.llm.packing import packing_stage
from kinmatch.llm.personal_data import personal_data_stage
from kinmatch.llm.quality import quality_stage
from kinmatch.session import scratch_folder

STAGES = [
    ("quality_rules", quality_stage),
    ("line_windows", line_windows_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-duplicate search, personal data and packing cannot be expressed in SQL, so the pipeline as a whole has none; only
#: the line stage's operator (op5) has. No test runs the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, each stored in the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}-{name}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
