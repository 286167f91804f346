"""Parquet tables of a scale-factor folder, and current versions of delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; only the columns and row groups a plan needs are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``: one partial aggregate, no sort of whole groups.

    Ties in ``order`` are broken by the values of ``cols``, so the result does not
    depend on arrival. Nulls in ``order`` lose to any value. Map columns can't be
    compared and must not be among ``cols``.
    """
    best = F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols if c not in keys])
