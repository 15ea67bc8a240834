"""Reading the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "legal_documents", "processed_documents", "document_embeddings", "cross_references", "amendments", "act_registry",
    "split_limits", "source_targets", "pack_capacities",
)


def reachable(spark: SparkSession) -> None:
    """Lets the Python workers of this session import the package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` (a Parquet file or folder) of ``sf_dir``."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for SQL passthrough."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def newest(df: DataFrame, key: str, order: str | None, *payload: str) -> DataFrame:
    """One row for each ``key``: the ``payload`` of the row with the greatest ``order`` (of equal ones the greatest payload).

    Operators run map-side over every stored state and pass only their compact result here, so that whole texts are never
    shuffled. A null ``order`` is below all others; a null ``key`` is one key of its own.
    """
    if order is None:
        kept = F.max(F.struct(*payload))
        return df.groupBy(key).agg(kept.alias("__kept")).select(key, *[F.col(f"__kept.{c}").alias(c) for c in payload])
    kept = F.max(F.struct(F.col(order).alias("__o"), *payload))
    return df.groupBy(key).agg(kept.alias("__kept")).select(key, *[F.col(f"__kept.{c}").alias(c) for c in payload])
