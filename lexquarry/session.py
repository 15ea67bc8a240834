"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` adds or overrides settings."""
    b = (
        SparkSession.builder.master(master)
        .appName("lexquarry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's ``spark.checkpoint.dir``; on a local master, if it is unset, one of our own.

    A folder of one machine is of no use to the executors of a cluster, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = os.path.join(tempfile.gettempdir(), "lexquarry-checkpoints")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame, fresh: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder; later reads survive the loss of executors.

    ``fresh`` also drops the size estimates of the plan: a loop whose joins multiply them would otherwise double their digits
    in every round. The files go when the result does, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint()
    if not fresh:
        return out
    j = out._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(j.queryExecution().toRdd(), j.schema(), False), spark)
