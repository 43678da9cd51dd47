"""A corpus pipeline of five stages over `documents`. Each stage is (spark, docs, sf_dir) -> DataFrame.

Quality: rejected documents go. Near duplicates (SimHash links and five-word similarity of 0.8 or more): of each group one row
stays, that of least doc_id. Decontamination: contaminated documents go. Secrets: findings are replaced in the texts.
Mixing: documents that the mix takes, range-sorted by their place in training, with what is taken of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common, decontam, mixing, quality, secrets, similar


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    score, kept = (common.fresh(n, docs.columns) for n in ("_score", "_kept"))
    return quality.classify(docs, model, docs.columns, (score, kept)).where(kept).drop(score, kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return judged.where(f"not {common.fresh('contaminated', docs.columns)}").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs, secrets.BlobLedger(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_training_order(mixing.mix(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
