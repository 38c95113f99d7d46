"""Integers out of textual entity ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fallback hash starts at 7 and multiplies by 31.
ROLLING_START = 7
ROLLING_FACTOR = 31


def numeric_suffix(entity_id: Column) -> Column:
    """N of ``client-N``; 0 where there is no such part."""
    digits = F.regexp_extract(entity_id, r"^[^-]*-(\d+)", 1)
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.cast("long"))


def rolling_hash(entity_id: Column) -> Column:
    """Polynomial hash of the characters, wrapped to a signed 32-bit integer."""
    modulus = F.lit(1 << 32)
    codes = F.transform(F.split(entity_id, ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(
        codes,
        F.lit(ROLLING_START).cast("long"),
        lambda acc, c: F.pmod(acc * ROLLING_FACTOR + c, modulus),
    )
    return F.when(folded >= (1 << 31), folded - modulus).otherwise(folded)


def entity_index(entity_id: Column) -> Column:
    """N of ``client-N``, else the rolling hash of the whole id."""
    digits = F.regexp_extract(entity_id, r"client-(\d+)", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(rolling_hash(entity_id))
