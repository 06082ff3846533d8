"""A training corpus from documents: quality, near duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoloom.llm import decontamination, mixing, neardup, pii, quality
from ecoloom.llm.common import fresh, identified, stored

#: Score below which the quality stage rejects; that of the operator's `predicted`.
LEAST_QUALITY = 0.7
#: Of the pseudonyms; a deployment sets its own.
KEY = "ecoloom-pseudonyms"


def without(rows: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """rows whose column `row` is not among those rejected, whatever their doc_id; without that column."""
    return rows.join(rejected.select(row), row, "left_anti").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    score = fresh(docs, "score")
    scored = quality.with_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score)
    return scored.filter(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the least doc_id (null last), of every group of near duplicates: similarity of
    0.8 and more on five words."""
    rows, row = identified(docs)
    found = stored(neardup.deduplicate(rows, percent=80, id_col=row).select(row, "component_id"), "components")
    ranked = found.join(rows.select(row, "doc_id"), row).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row))
    first = ranked.groupBy("component_id").agg(F.min("rank")[row].alias("first"))
    return without(rows, row, found.join(first, "component_id").filter(F.col(row) != F.col("first")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    digest = fresh(docs, "digest")
    rows = docs.withColumn(digest, F.md5(F.encode("text", "UTF-8")))  # equal texts hold the same windows
    checked = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=digest)
    return without(rows, digest, checked.filter("n_hit > 0"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms for personal data; n_chars follows the text."""
    spans, count = fresh(docs, "private"), fresh(docs, "n_private")
    done = pii.pseudonymise(docs, KEY, spans_col=spans, count_col=count)
    return done.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, sorted by their position in training."""
    return mixing.scheduled(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the keyed pseudonyms are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
