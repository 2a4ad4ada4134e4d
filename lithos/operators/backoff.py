"""Backoff lookup: the most specific level whose statistics suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def levels(keys: list[str]) -> F.Column:
    """Array of (level, key): all keys, then without the first, the first two, ...; the last level is global."""
    return F.array(*[F.struct(F.lit(i).alias("level"), F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys[i:]], F.lit(f"#{i}")).alias("key")) for i in range(len(keys) + 1)])


def leveled(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per level, with columns level and key. Aggregate by the keys first: then few rows are multiplied."""
    return df.withColumn("_l", F.explode(levels(keys))).select("*", "_l.level", "_l.key").drop("_l", *keys)


def backoff(requests: DataFrame, stats: DataFrame | list[str], keys: list[str], on: list[str], suffices, most_level: int | None = None) -> DataFrame:
    """requests(*keys, *on) joined with the first level of stats(level, key, *on, ...) that suffices.

    Where stats are names, the requests' own columns, summed by level, are the statistics, and suffices is a function of
    their struct. The sums of all levels are made side by side, so requests that are dealt by one of on stay where they are.
    """
    if isinstance(stats, list):
        found = requests
        for i in range(len(keys) + 1):
            by = W.partitionBy(*on, *[F.coalesce(F.col(k), F.lit("")) for k in reversed(keys[i:])])
            found = found.withColumn(f"_{i}", F.struct(F.lit(i).alias("level"), *[F.sum(c).over(by).alias(c) for c in stats]))
        first = F.coalesce(*[F.when(suffices(F.col(f"_{i}")), F.col(f"_{i}")) for i in range(len(keys) + 1)])
        return found.withColumn("_b", first).where("_b IS NOT NULL").select(*keys, *on, "_b.*")
    asked = requests.withColumn("_l", F.explode(levels(keys))).select(*requests.columns, "_l.level", "_l.key")
    good = stats.where(suffices if most_level is None else suffices & (F.col("level") <= most_level))
    own = [c for c in stats.columns if c not in ("key", *on)]
    found = asked.join(good, ["level", "key", *on]).groupBy(*requests.columns).agg(F.min(F.struct(*own)).alias("_b"))
    return found.select(*requests.columns, *[F.col("_b")[c].alias(c) for c in own])
