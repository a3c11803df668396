"""Unit algebra: factors such that claimed value * factor = table value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# Pairs of normalised units with an agreed factor.
FACTORS = {
    ("triliun rp", "miliar rp"): 1000.0,
    ("miliar rp", "miliar rp"): 1.0,
    ("triliun rp", "triliun rp"): 1.0,
    ("miliar rp", "triliun rp"): 0.001,
    ("miliar usd", "juta usd"): 1000.0,
    ("miliar dolar as", "juta usd"): 1000.0,
    ("miliar dolar", "juta usd"): 1000.0,
    ("billion usd", "juta usd"): 1000.0,
    ("juta usd", "juta usd"): 1.0,
    ("miliar usd", "miliar usd"): 1.0,
    ("miliar dolar as", "miliar dolar as"): 1.0,
    ("juta usd", "miliar usd"): 0.001,
    ("juta usd", "miliar dolar as"): 0.001,
}
# Decimal scales and currencies by word.
SCALES = {
    "ribu": 1e3, "thousand": 1e3, "juta": 1e6, "million": 1e6, "miliar": 1e9, "milyar": 1e9, "billion": 1e9,
    "triliun": 1e12, "trillion": 1e12,
}
CURRENCIES = {"rp": "rp", "rupiah": "rp", "idr": "rp", "usd": "usd", "dolar": "usd", "dollar": "usd"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def parse_scale(unit: Column) -> Column:
    """struct(scale, currency) of a level unit; null for percentages and units without scale and currency."""
    words = F.regexp_extract_all(F.lower(unit), F.lit("[a-z]+"), F.lit(0))

    def parsed(w: Column) -> Column:
        scale = F.aggregate(w, F.lit(1.0), lambda a, x: a * F.coalesce(F.try_element_at(_map(SCALES), x), F.lit(1.0)))
        currency = F.try_element_at(F.filter(F.transform(w, lambda x: F.try_element_at(_map(CURRENCIES), x)), lambda c: c.isNotNull()), F.lit(1))
        known = F.exists(w, lambda x: x.isin(*SCALES)) | currency.isNotNull()
        return F.when(known & ~F.array_contains(w, "persen"), F.struct(scale.alias("scale"), currency.alias("currency")))

    return F.when(~F.contains(unit, F.lit("%")), let(words, parsed))


def factor(claimed: Column, table: Column) -> Column:
    """The factor from a claim's unit to a table's; null if unknown or either is missing or empty."""
    a, b = strip(F.lower(claimed)), strip(F.lower(table))
    listed = F.try_element_at(_map({f"{x}\u0001{y}": f for (x, y), f in FACTORS.items()}), F.concat(a, F.lit("\u0001"), b))
    ratio = let(parse_scale(a), lambda x: let(parse_scale(b), lambda y: F.when(x["currency"] == y["currency"], x["scale"] / y["scale"])))
    return F.when((claimed != "") & (table != ""), F.coalesce(listed, F.when(a == b, F.lit(1.0)), ratio))


def column_unit(label: Column) -> Column:
    """The bracketed unit at the end of a column name, or null."""
    return F.nullif(strip(F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)), F.lit(""))


def scale_only(unit: Column) -> Column:
    """The claim's own scale, for sources that state no unit at all; 1 if it has none."""
    return F.coalesce(parse_scale(strip(F.lower(unit)))["scale"], F.lit(1.0))
