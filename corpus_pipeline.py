"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, benchmark leaks go, secrets are masked, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.llm import decontamination, ngram_join, packing, secret_scan, toxicity
from latentspark.llm.common import numbered, passing, saved, sized_hint, small_batches, whole

#: Numbers of rows that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold, each row by its own text, null and repeated ids too. The lexicon is learned from the labelled rows of docs; without any, and for null and empty texts, nothing is toxic."""
    with small_batches(spark), passing(spark):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(spark, docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that with the least doc_id, nulls last, and one of several such. Documents without words all stay."""
    rows, number = numbered(docs)
    with passing(spark) as keep:
        gone = keep(_spare(spark, rows, number))
    return rows.join(sized_hint(gone, BROADCAST_ROWS), number, "left_anti").select(*docs.columns)


def _spare(spark: SparkSession, rows: DataFrame, number: str) -> DataFrame:
    """Numbers of the rows whose group has another one that stays."""
    groups = ngram_join.jaccard_components(spark, rows.select(F.col(number).alias("doc_id"), "text"), count_links=False).where("n_shingles > 0")
    named = saved(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("grp")).join(rows.select(F.col(number).alias("row"), "doc_id"), "row"))
    stays = named.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", F.col("s.row").alias("stays"))
    return named.join(stays, "grp").where("row != stays").select(F.col("row").alias(number))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or reworded; null and repeated ids are rows like others, null and empty texts stay."""
    return decontamination.without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; null and repeated ids, null and empty texts stay as they are."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and where they lie in which sequence."""
    return packing.pack_documents(spark, docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Models and searches that SQL cannot express: tests compare each stage with a brute-force version.
ORACLE_SQL = None


@whole
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents; what the stages before it wrote is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
