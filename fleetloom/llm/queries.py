"""Queries over the documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm import mixing, packing, subjects
from fleetloom.llm.tokens import with_tokens
from fleetloom.session import load, staged


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(with_tokens(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), "sized")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its container of 2,048 tokens."""
    packed = packing.pack(_sized(spark, sf_dir), "doc_id", "tokens")
    return packed.select("container_id", "doc_id", "piece_no", F.col("start").alias("start_token"), F.col("n").alias("tokens"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least possible, and the share of unused space."""
    boxes = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("n"))
    capacity = F.lit(packing.CAPACITY)
    return boxes.agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"),
        F.ceil(F.sum("n") / capacity).alias("least_containers"), (1 - F.sum("n") / (F.count("*") * capacity)).alias("unused_share"),
    )


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture."""
    return mixing.mixture(_sized(spark, sf_dir), load(spark, sf_dir, "mixture_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    sized, targets = _sized(spark, sf_dir), load(spark, sf_dir, "mixture_targets")
    return mixing.report(staged(mixing.mixture(sized, targets), "mixture"), sized, targets)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [load(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")]
    return subjects.subjects_of(*tables)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject, also as a share of all; the null subject counts documents without any."""
    all_docs = load(spark, sf_dir, "documents").select("doc_id")
    joined = all_docs.join(_subjects(spark, sf_dir), "doc_id", "left")
    counts = joined.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
    return counts.join(F.broadcast(all_docs.agg(F.countDistinct("doc_id").alias("n")))).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_summary, p8_mixture, p8_report, p9_found, p9_composition)}

# Token counts, optimised packings and trained models can't be expressed in SQL: these are tested
# against brute force, exact sums and held-out labels.
SQL: dict[str, str] = {}
