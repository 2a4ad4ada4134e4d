"""Several tables in one folder, replaced together: each commit is a new version, and a version is whole or not there.

A version is written beside the others and then renamed to v<n>, which fails if another writer was first. That rename is
one step on HDFS (on local disks, as in tests, the check for an existing version and the rename are two); a store without
such a rename needs a committer of its own. Readers take the highest version; old ones stay readable until vacuum(), so a running query never loses its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.structure import violations


class Conflict(Exception):
    """Another writer has committed since the version that a commit is based on."""


class Rejected(Exception):
    """An import that would change nothing or breaks rules; the stored version stays."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    _, fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def latest(spark: SparkSession, path: str) -> int | None:
    return max(versions(spark, path), default=None)


def read(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version}/{name}")


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], base: int | None) -> int:
    """Write all tables as the version after base; a Conflict, and nothing is changed, if there is one already."""
    hadoop, fs, at = _files(spark, path)
    fs.mkdirs(at)
    scratch, version = f"{path}/_{uuid.uuid4().hex}", 1 if base is None else base + 1
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{scratch}/{name}")
        options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        files = hadoop.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
        try:
            files.rename(hadoop.Path(scratch), hadoop.Path(f"{path}/v{version}"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {version} of {path} was committed by another writer") from None
            raise
    finally:
        fs.delete(hadoop.Path(scratch), True)
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last versions."""
    hadoop, fs, _ = _files(spark, path)
    for v in versions(spark, path)[:-keep]:
        fs.delete(hadoop.Path(f"{path}/v{v}"), True)


def updated(spark: SparkSession, path: str, change: Callable[[int | None], dict[str, DataFrame]], tries: int = 5) -> int:
    """Commit change(base), and do it again on the new version where another writer was first."""
    for left in reversed(range(tries)):
        base = latest(spark, path)
        try:
            return commit(spark, path, change(base), base)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def import_extracts(spark: SparkSession, path: str, arriving: dict[str, DataFrame], rules: dict[str, dict[str, Column]], key: str = "source_extract_id", tries: int = 5) -> DataFrame:
    """Replace all rows of the extracts that arrive, in all tables at once; returns key and <table>_deleted, <table>_inserted.

    An extract's old rows go from every table, also from one in which it has no rows any more; rows without an extract
    stay. An import without rows, with a row without an extract, or with a row that breaks a rule is Rejected as a whole.
    The counters are a table of the version, so they are those of the commit that took place.
    """
    broken: dict[str, int] = {}
    for name, rows in arriving.items():
        found = rows.select(F.explode(violations({f"{name}.{key}": F.col(key).isNotNull()} | {f"{name}.{r}": ok for r, ok in rules.get(name, {}).items()})).alias("rule"))
        broken |= {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}  # a row per rule
    if broken:
        raise Rejected(", ".join(f"{k}: {n} rows" for k, n in sorted(broken.items())))
    if all(rows.isEmpty() for rows in arriving.values()):
        raise Rejected("nothing to import")
    extracts = None
    for rows in arriving.values():
        extracts = rows.select(key) if extracts is None else extracts.union(rows.select(key))
    extracts = extracts.distinct()

    def change(base: int | None) -> dict[str, DataFrame]:
        out, counters = {}, extracts
        for name, rows in arriving.items():
            old = rows.limit(0) if base is None else read(spark, path, name, base)
            out[name] = old.join(extracts, key, "left_anti").unionByName(rows, allowMissingColumns=True)
            for what, counted in (("deleted", old), ("inserted", rows)):
                n = counted.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_{what}"))
                counters = counters.join(n, key, "left").fillna(0, [f"{name}_{what}"])
        return out | {"_counters": counters}

    return read(spark, path, "_counters", updated(spark, path, change, tries))
