"""A training corpus from documents: filter by quality, label lines, deduplicate, mix sources and pack.

Every stage works on all documents that the stage before kept. Stages 1 to 4 return the columns of
documents; packing returns one row per piece. Models are trained on labels of the training fold only.

Defined cases are those of the operators; columns of any name ride along. After near-duplicate removal a
group has one row, also where ids are null, shared by several texts, or of another integer type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op2_line_crf, op3_near_dedup, op5_mixing, op7_quality, op9_packing
from lodestone.llm.common import quoted, table, unused
from lodestone.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good."""
    model = op7_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = unused(docs.columns, "quality_score")
    scored = op7_quality.score(docs, model, docs.columns, name)
    return scored.where(F.col(name) >= op7_quality.THRESHOLD).drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose words lie in content lines."""
    field = op2_line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    prefix = unused(docs.columns, "line_")
    labelled = op2_line_crf.label_documents(docs, field, docs.columns, prefix)
    return labelled.where(F.col(f"{prefix}kept")).select(*map(quoted, docs.columns))


#: Words of a shingle, percent of similarity, and hashes of a band (a pair at 0.80 is missed with 5e-8).
SHINGLE, PERCENT, ROWS = 5, 80, 4


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    name = unused(docs.columns, "row_hash")
    leading = op3_near_dedup.near_duplicates(docs, SHINGLE, PERCENT, ROWS).where("leads").select(F.col("row_hash").alias(name)).distinct()
    once = docs.withColumn(name, op3_near_dedup.row_hash()).dropDuplicates([name])
    return once.join(leading, name, "left_semi").drop(name)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target shares, documents repeated or left out whole."""
    return op5_mixing.mix(docs, whole=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return op9_packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Stages use trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
