"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidewell.llm.common import bounded_batches, cut, near_or_exchanged, table
from guidewell.llm.components import components
from guidewell.llm.mixing import mix_sources
from guidewell.llm.near_copies import near_copies
from guidewell.llm.packing import digest, pack_documents, tokenizer_path
from guidewell.llm.quality_rules import quality_rules
from guidewell.llm.simhash import simhash_components
from guidewell.llm.toxicity import score_toxicity

#: The stages share their executors, whose JVM never gives memory back: batches, and what either side makes of one, are smaller than where an operator runs alone.
BATCH_BYTES = "1m"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. A document without an id cannot be told from others and stays."""
    bounded_batches(spark, BATCH_BYTES)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    toxic = cut(scored.where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct(), "toxic-ids")
    return docs.join(near_or_exchanged(toxic), F.col("doc_id") == F.col("__id"), "left_anti")


def _set_aside(docs: DataFrame, *read: str) -> tuple[DataFrame, list]:
    """``docs`` with all columns but those that are ``read`` under names of their own, and the columns that undo it: an operator's names clash with none."""
    names = [c if c in read else f"__{i}" for i, c in enumerate(docs.columns)]
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    bounded_batches(spark, BATCH_BYTES)
    plain, back = _set_aside(docs, "text")
    return quality_rules(plain).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more, or a link between
    SimHash fingerprints of five-word shingles), joined by links, the document with the least id stays; of repeated ids one row stays, the least by its other columns;
    documents without an id link with nothing and stay."""
    bounded_batches(spark, BATCH_BYTES)
    found = cut(simhash_components(docs.select("doc_id", "text"), size=5).select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")), "fingerprint-links")
    edges = near_copies(docs.select("doc_id", "text"))
    gone = cut(components(found.where("u <> v").unionByName(edges)).select(F.col("node").alias("__id")), "copy-ids")
    kept = docs.join(near_or_exchanged(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    again = cut(found.where("u is not null").groupBy("u").count().where("count > 1").select(F.col("u").alias("__id")), "repeated-ids")
    if again.isEmpty():
        return kept
    again = near_or_exchanged(again)
    others = [c for c in docs.columns if c != "doc_id"]
    once = kept.join(again, F.col("doc_id") == F.col("__id"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("__r")).select("doc_id", *[F.col(f"__r.{c}").alias(c) for c in others])
    return kept.join(again, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(once.select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    plain, back = _set_aside(docs, "doc_id", "text", "source")
    mixed = mix_sources(plain, carry=True).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    bounded_batches(spark, BATCH_BYTES)
    return digest(pack_documents(docs, tokenizer_path(), remembered=200_000, slice_bytes=1 << 20))  # the stages before leave an executor less memory


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
