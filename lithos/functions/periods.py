"""Construction-period codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.vocab import PERIODS


def codes(bp: Column) -> Column:
    """The period codes in a list like '0,1,2'; tokens that are not digits are skipped."""
    tokens = F.filter(F.split(bp, ","), lambda t: t.rlike(r"^\s*\d+\s*$"))
    return F.transform(tokens, lambda t: F.trim(t).try_cast("int"))


def collapse_bp(bp: Column) -> Column:
    """One code: the earliest known period, else 0."""
    return F.coalesce(F.array_min(F.filter(codes(bp), lambda c: c != 0)), F.lit(0))


def has_period(bp: Column, wanted: list[int]) -> Column:
    """Whether any code of the list is wanted."""
    return F.coalesce(F.exists(codes(bp), lambda c: c.isin(*wanted)), F.lit(False))


def label(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), code), F.lit("unbekannt"))


def label_or_list(best: Column, bp: Column) -> Column:
    """The best guess's label if there is a guess, else the joined labels of all tokens of the list, else 'unbekannt'."""
    tokens = F.transform(F.split(F.nullif(bp, F.lit("")), ","), lambda t: label(F.when(F.trim(t) == "", 0).otherwise(F.trim(t).try_cast("int"))))
    return F.coalesce(F.when(best.isNotNull(), label(best)), F.array_join(tokens, ", "), F.lit("unbekannt"))
