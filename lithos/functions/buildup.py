"""The typed notation of build-ups: 'Putz 15 Ziegel _ Putz'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.vocab import FALLBACK_MM, LAYER_MM


def matched(word: Column, vocabulary: list[str]) -> Column:
    """The first material that equals a word, else begins with it, else holds it, without regard to case; else null."""
    names, w = F.array(*map(F.lit, vocabulary)), F.lower(word)
    first = lambda test: F.get(F.filter(names, test), F.lit(0))
    return F.coalesce(first(lambda m: F.lower(m) == w), first(lambda m: F.startswith(F.lower(m), w)), first(lambda m: F.contains(F.lower(m), w)))


def parsed(line: Column, measured_mm: Column, vocabulary: list[str], connections: list[str], presets: dict[str, float] | None = None) -> Column:
    """Array of (material, thickness in whole mm), or null where a token names no material.

    A material is one token. It may be followed by its thickness or by _; without either it has its usual one. Those with
    _ share equally what the measured total leaves, or have 50 mm each where nothing was measured. Connections have none.
    presets come before the usual thicknesses.
    """
    usual = LAYER_MM | (presets or {})
    usual_mm = F.create_map(*[F.lit(x) for m, mm in usual.items() for x in (m, float(mm))])
    tokens = F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda t: t != "")
    number = r"^\d+(?:[.,]\d+)?$"
    size = lambda t: t.isNotNull() & ((t == "_") | t.rlike(number))
    # a token is a size if it looks like one and the token before it is none
    marked = F.aggregate(
        tokens,
        F.array().cast("array<struct<name:string,size:string>>"),
        lambda acc, t: F.when(
            size(t) & (F.size(acc) > 0) & F.element_at(acc, -1)["size"].isNull(),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["name"].alias("name"), t.alias("size")))),
        ).otherwise(F.concat(acc, F.array(F.struct(t.alias("name"), F.lit(None).cast("string").alias("size"))))),
    )
    named = F.transform(marked, lambda x: F.struct(matched(x["name"], [*vocabulary, *connections]).alias("material"), x["size"].alias("size")))
    zero = lambda m: F.coalesce(m.isin(*connections), F.lit(False))
    given = lambda x: F.when(zero(x["material"]), 0.0).when(x["size"].isNull(), F.coalesce(F.element_at(usual_mm, x["material"]), F.lit(float(FALLBACK_MM)))).when(x["size"] != "_", F.regexp_replace(x["size"], ",", ".").try_cast("double"))
    rows = F.transform(named, lambda x: F.struct(x["material"].alias("material"), given(x).alias("t")))
    fixed = F.aggregate(rows, F.lit(0.0), lambda s, x: s + F.coalesce(x["t"], F.lit(0.0)))
    n_open = F.size(F.filter(rows, lambda x: x["t"].isNull()))
    whole = lambda v: F.floor(v + 0.5).cast("double")
    share = whole(F.when(measured_mm.isNull(), float(FALLBACK_MM)).otherwise(F.greatest(F.lit(0.0), measured_mm - fixed) / F.greatest(n_open, F.lit(1))))
    out = F.transform(rows, lambda x: F.struct(x["material"].alias("material"), F.when(x["t"].isNotNull(), F.greatest(F.lit(0.0), whole(x["t"]))).otherwise(share).alias("thickness")))
    return F.when((F.size(rows) > 0) & F.forall(rows, lambda x: x["material"].isNotNull()), out)
