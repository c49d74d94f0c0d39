"""The corpus pipeline: five stages from raw documents to a weighted training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's `docs`. All but
the last keep the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import batches, decontamination, mixing, ngram_join, pii, quality_rules, queries
from paddock.session import cut

#: A list of ids up to this many rows is broadcast; a longer one is joined by shuffle.
LIST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_rules(docs, queries.trusted(spark, sf_dir)).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Rows with the same id (repeated rows) count as one document and leave one row. Rows without an id stay.
    """
    classes = ngram_join.ngram_join(docs)
    extra = cut(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct())
    repeated = cut(classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    left = docs.join(batches.bounded_broadcast(extra, LIST_ROWS), F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = batches.bounded_broadcast(repeated, LIST_ROWS)
    once = left.join(twice, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(left.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = cut(found.select(F.col("doc_id").alias("_gone")).where("_gone IS NOT NULL"))
    return docs.join(batches.bounded_broadcast(gone, LIST_ROWS), F.col("doc_id") == F.col("_gone"), "left_anti").select(docs.columns)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars follows the text."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A rate for every document: how often to draw it so that the domains meet their token targets."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", sanitised),
    ("mixing", mix),
]

#: Hashed multinomials, MinHash and alignment have no SQL text; tests/llm compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
