"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies; a cluster without a shared code folder uses --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, rows: int) -> int:
    """The partitions that hold about so many rows of df each, by counting them: a small file can unpack to much work, so
    neither its bytes nor a fixed number tells how many tasks a step needs."""
    return max(1, -(-df.count() // rows))


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster each executor would write to its
    own disk there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lithos-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the session's shared folder."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table in the session's shared folder, which is columnar and packed: for large rows."""
    path = f"{shared_base(df.sparkSession)}/lithos/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
