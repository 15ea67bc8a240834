"""Tables that change: inserts, upserts, cascading deletes, versions, and key-value caches, all as copy-on-write frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Adds rows to a Parquet table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], as_of: str | None = None) -> DataFrame:
    """``base`` with ``columns`` taken from ``updates`` where a key matches; of several updates of a key the greatest counts.

    ``updated_at`` is set to ``as_of`` on changed rows if both are given.
    """
    one = updates.groupBy(key).agg(F.max(F.struct(*columns)).alias("__u"))
    d = base.join(one, key, "left")
    hit = F.col("__u").isNotNull()
    d = d.withColumns({c: F.when(hit, F.coalesce(F.col(f"__u.{c}"), F.col(c))).otherwise(F.col(c)) for c in columns})
    if as_of and "updated_at" in base.columns:
        d = d.withColumn("updated_at", F.when(hit, F.lit(as_of).cast(dict(base.dtypes)["updated_at"])).otherwise(F.col("updated_at")))
    return d.select(*base.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys in ``gone`` and the rows that refer to them."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys.withColumnRenamed(key, foreign), foreign, "left_anti")


def new_rows(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not yet known."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def in_order(keys: Sequence, df: DataFrame, key: str) -> DataFrame:
    """One row for each of ``keys`` in their order, repeats included; missing rows are null. At most 1,000 keys."""
    if len(keys) > 1000:
        raise ValueError("at most 1000 keys")
    kind = dict(df.dtypes)[key]
    asked = df.sparkSession.createDataFrame(list(enumerate(keys)), f"pos int, {key} {kind}")
    return F.broadcast(asked).join(df.dropDuplicates([key]), key, "left").orderBy("pos")


def newest_version(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), tie)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def cache_key(endpoint: Column, params: Column) -> Column:
    """Digest of an endpoint and its parameters (a map) in key order."""
    pairs = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.sha2(F.concat_ws(":", endpoint, F.array_join(pairs, "&")), 256)


def shard(key: Column) -> Column:
    return F.substring(key, 1, 2)


def stage_key(document: Column, stage: Column, params: Column) -> Column:
    return F.concat_ws("/", document, stage, F.substring(F.sha2(F.coalesce(params, F.lit("")), 256), 1, 16))


def live_versions(df: DataFrame, keys: Sequence[str], order: str, ttl_seconds: int, as_of: str) -> DataFrame:
    """The latest entry of each key that has not expired at ``as_of``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    d = df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return d.where(F.unix_timestamp(F.col(order).cast("timestamp")) + ttl_seconds > F.unix_timestamp(F.lit(as_of).cast("timestamp")))


def sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """SQL passthrough with named arguments; nothing is interpolated into the text."""
    return spark.sql(text, args=args or None)


def write_sharded(df: DataFrame, path: str, key: str = "key") -> None:
    """A key-value table in folders of the first two signs of the key."""
    df.withColumn("shard", shard(F.col(key))).write.mode("append").partitionBy("shard").parquet(path)


def read_sharded(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Point lookup that reads one folder only."""
    return spark.read.parquet(path).where((F.col("shard") == key[:2]) & (F.col("key") == key))
