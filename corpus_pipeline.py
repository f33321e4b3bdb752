"""Corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import budget_mix, context_net, line_index, multi_order, piece_paths
from plumbline.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; learnt from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors, network = context_net.fit(docs, labels)
    return context_net.score(docs, vectors, network).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold are taken out; a document that loses all of them stays, with an empty text. Null texts stay null."""
    out = line_index.without_frequent_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("bigint")} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of near copies; equal rows are kept once."""
    found = written(multi_order.near_duplicates(docs))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("rows"))
    once, more = first.filter("rows = 1"), first.filter("rows > 1")
    same = lambda ids: docs["doc_id"].eqNullSafe(ids["_id"])
    return docs.join(once, same(once), "left_semi").union(docs.join(more, same(more), "left_semi").dropDuplicates(["doc_id", "text"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = budget_mix.mix(docs).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with their number and the check that decoding gives the text back."""
    return piece_paths.encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixture),
    ("SentencePiece", pieces),
]

# The classifier, the mix and the encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
