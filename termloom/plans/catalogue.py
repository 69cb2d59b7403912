"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analysis, native, roles, rules, rules_sql, statements
from .dialect import bind, spell, with_roles


def apply(spark: SparkSession, name: str, **frames: DataFrame) -> DataFrame:
    """Runs an operator that is a statement on frames given by role, e.g. apply(spark, "a1_group_statistics", kw=keywords)."""
    text = spell(statements.STATEMENTS[name], spark=True)
    return spark.sql(bind(text, list(frames)), **frames)


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = statements.STATEMENTS[name]
        frames = {r: roles.role(spark, sf_dir, r) for r in roles.used(text, roles.ROLES)}
        frames |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in roles.used(text, roles.TABLES)}
        return apply(spark, name, **frames)

    return run


def queries() -> dict:
    return {name: _query(name) for name in statements.STATEMENTS} | native.QUERIES | rules.QUERIES | analysis.QUERIES


def oracle_sql() -> dict[str, str]:
    def sql(text: str) -> str:
        return spell(with_roles(text, {r: roles.ROLES[r] for r in roles.used(text, roles.ROLES)}), spark=False).replace(" AS STRING)", " AS VARCHAR)")

    return {name: sql(text) for name, text in statements.STATEMENTS.items()} | {name: sql(text) for name, text in native.SQL.items()} | rules_sql.oracle_sql() | analysis.oracle_sql()
