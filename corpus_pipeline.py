"""Corpus pipeline: toxicity, near-dedup, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of documents, whatever their
names; rows that repeat stay or go as said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import decontaminate, neardup, packing, suffixes, toxicity, work


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; null, empty and word-less texts stay, and an empty table stays empty (see ``toxicity.drop_toxic``)."""
    return toxicity.drop_toxic(docs, work.read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id; rows that repeat a doc_id, or have none, are judged each by
    its own text, and texts without words all stay (see ``neardup.deduplicated``)."""
    return neardup.deduplicated(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the texts; a text that nothing is left of goes (see ``suffixes.cut_passages``)."""
    return suffixes.cut_passages(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay (see ``decontaminate.remove_contaminated``)."""
    return decontaminate.remove_contaminated(docs, work.read(spark, sf_dir, "benchmark").select("item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts left, packed into sequences; every row has at least one, its closing id (see ``packing.pack``)."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("repeated_passages", passages_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL states a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = work.store(stage(spark, docs, sf_dir), name)
    return docs
