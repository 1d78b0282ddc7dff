"""Columns that an operator carries along without looking at them.

They travel as one struct, so none of their names can clash with an operator's
own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHERS = "_others"


def pack(df: DataFrame, used: list[str]) -> DataFrame:
    """The used columns, and all others as one struct."""
    others = [c for c in df.columns if c not in used]
    carried = F.struct(*[df[c] for c in others]) if others else F.lit(None).cast("string")
    return df.select(*[df[c] for c in used], carried.alias(OTHERS))


def unpack(df: DataFrame, names: list[str], used: list[str], **values: Column) -> DataFrame:
    """The columns ``names`` again, in order, with some values replaced."""
    return df.select(*[values.get(c, F.col(c) if c in used else F.col(OTHERS)[c]).alias(c) for c in names])


def identity(*values: Column | str) -> Column:
    """128 bits of hash that name a row by its values."""
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))
