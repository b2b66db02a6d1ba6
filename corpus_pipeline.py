"""A corpus pipeline: language ID, near-duplicates, decontamination, secrets and token ids.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; all but the last
return the columns of documents. Rows with null or empty texts go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, neardup, pieces, secrets
from tessella.llm.decontaminate import decontaminate as find_leaks
from tessella.llm.storage import written


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): operators carry the whole row as their id."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which one known language has two fifths of the letters at least."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(whole_rows(docs), model, "row")
    return found.where("lang_pred <> 'und' and score >= 0.4").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a window of a benchmark item."""
    found = find_leaks(whole_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row", null_items=True)
    return found.where("size(spans) = 0").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live secrets; copied examples and weak values stay."""
    return secrets.redacted(docs, repo_col="doc_id")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text."""
    return pieces.round_trips(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language", identify),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("pieces", tokenize),
]

#: SQL can't express the trained model, the sampled sketches or the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
