"""All queries of the engine by name, and their oracles."""

from __future__ import annotations

from ..fixtures import duck, run
from .mutations import MUTATIONS
from .reads import DIALECT, READS


def _texts(sql: str) -> tuple[str, str]:
    spark, other = sql, sql
    for mark, (a, b) in DIALECT.items():
        spark, other = spark.replace(mark, a), other.replace(mark, b)
    return spark, other


def queries() -> dict:
    reads = {name: (lambda spark, sf_dir, sql=_texts(sql)[0]: run(spark, sf_dir, sql)) for name, sql in READS.items()}
    return reads | {name: f for name, (f, _) in MUTATIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck(_texts(sql)[1]) for name, sql in READS.items()} | {name: duck(sql) for name, (_, sql) in MUTATIONS.items()}
