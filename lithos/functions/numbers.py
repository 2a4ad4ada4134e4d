"""Numbers, units and ranges as users and the API write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def parse_user_number(text: Column) -> Column:
    """German input: 'beliebig' is infinity, '1.234,5' and '1.234' have thousands points, '10,5' a decimal comma."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[€\s]", "")
    grouped = bare.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    plain = F.when(grouped, F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", "."))
    return F.when(bare == "beliebig", F.lit(INFINITY)).when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("double"))


def parse_api_number(text: Column) -> Column:
    """API values: '3.000' is three; spaces go, a comma is a decimal point, all else is null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s", ""), ",", ".")
    return F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), bare.try_cast("double"))


def price_range(low: Column, high: Column) -> tuple[Column, Column]:
    """(minimum, maximum): 0 and infinity by default, swapped where inverted, not below 0."""
    a = F.coalesce(F.when(low != INFINITY, low), F.lit(0.0))
    b = F.coalesce(high, F.lit(INFINITY))
    return F.greatest(F.lit(0.0), F.least(a, b)), F.greatest(F.lit(0.0), F.greatest(a, b))


#: The units of listings, each with the spellings that count as it.
UNITS = {
    "Stück": ["Stück", "Stueck", "StÃ¼ck"], "Kubikmeter": ["Kubikmeter", "m3", "m³"], "Quadratmeter": ["Quadratmeter", "m2", "m²"],
    "Meter": ["Meter"], "Kilogramm": ["Kilogramm", "kg"],
}


def canonical_unit(unit: Column) -> Column:
    """The unit that a spelling stands for, with regard to case; null for any other."""
    by = F.create_map(*[F.lit(x) for name, spellings in UNITS.items() for s in spellings for x in (s, name)])
    return F.element_at(by, F.trim(unit))


def date_only(text: Column) -> Column:
    """The date in the first ten characters, else null."""
    return F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10).try_cast("date"))


def slider_index(value: Column, options: list[float], unbounded: bool = True) -> Column:
    """Index of the nearest of the ascending options; of two as near, the first. Beyond the last one comes that of infinity,
    if unbounded. The last option not above the value is found by halving, so a value costs the logarithm of their number."""
    if any(a >= b for a, b in zip(options, options[1:])):
        raise ValueError("options must ascend")
    known = F.array(*[F.lit(float(o)) for o in options])
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(options).bit_length()))])
    at = F.aggregate(halves, F.lit(0), lambda i, step: F.when(F.get(known, i + step) <= value, i + step).otherwise(i))
    nearest = F.get(F.transform(F.array(at), lambda i: F.when(F.abs(value - F.get(known, i + 1)) < F.abs(value - F.get(known, i)), i + 1).otherwise(i)), F.lit(0))
    beyond = (value > float(options[-1])) | F.isnan(value)
    return F.when(beyond | (value == -INFINITY), F.lit(len(options) - (not unbounded))).otherwise(nearest)


def file_name(text: Column, most: int = 180) -> Column:
    """A name that is safe to store: no path, no control or reserved characters."""
    base = F.regexp_extract(text, r"([^/\\]*)$", 1)
    return F.left(F.regexp_replace(base, r'[\x00-\x1f<>:"|?*]', "_"), F.lit(most))


def first_error_line(text: Column, kind: Column, most: int = 200) -> Column:
    """The first line of an error without paths of either kind; the error's class where nothing is left."""
    line = F.btrim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1), F.lit(" \t\n\r\x0b\x0c"))
    bare = F.regexp_replace(line, r"(?U)(?:[A-Za-z]:\\|/)[\w.\-\\/]+", "")
    return F.left(F.btrim(F.coalesce(F.nullif(bare, F.lit("")), kind), F.lit(" \t\n\r\x0b\x0c")), F.lit(most))


def name_uuid(text: Column) -> Column:
    """The first 16 bytes of a text's SHA-256 as a UUID with version 4 and its variant set."""
    h = F.sha2(text, 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
