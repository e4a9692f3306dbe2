"""Session settings the engine expects."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "driftwarden", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything else comes from ``settings`` or the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they see the same path; elsewhere it is installed or sent by the cluster."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def small_methods(spark: SparkSession) -> SparkSession:
    """Rows of a plan whose generated method is over 8,000 bytes are taken an operator at a time: the JVM never compiles a longer method, and interprets it."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. In local mode, where one machine runs all, a local one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for written tables")
    return named or "file:///tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/driftwarden/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, where several branches go on from it.

    The branches then read one table instead of each repeating the plan, and a lost executor costs a read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``tables``; nothing that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
