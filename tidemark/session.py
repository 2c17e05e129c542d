"""Spark sessions with the settings that the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC makes local wall clocks explicit; AQE splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local (tests, a single machine)
    is a temporary one made and used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and its lineage cut, by a checkpoint in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
