"""Helpers of the training-data operators: tables, shared scratch folders, lineage cuts and word patterns."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.session import read_table as table  # noqa: F401
from lithos.session import shared_base

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHAR = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which the driver and all executors share."""
    return f"{shared_base(spark)}/lithos/{name}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are removed at the end, but for those that are to be kept: what leaves must not read them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, keep: bool = False, level: int = 1) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and lost executors cost nothing.

    Of nested scratches, the level-th from within removes it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _open and not keep:
        _open[-level].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
