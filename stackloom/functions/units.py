"""Height units: guessing from the value range of a stack, and conversion to nanometres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.model import finite

#: Nanometres in one unit: fixed values.
TO_NM = {"pm": 1e-3, "nm": 1.0, "um": 1e3, "mm": 1e6, "m": 1e9}
#: Ranges (max - min) above each limit have the unit; below all it is "m": fixed values.
RANGE_UNITS = [(1e4, "pm"), (1e-2, "nm"), (1e-4, "um"), (1e-5, "mm")]
#: Units that are not lengths, left as they are: fixed values.
NOT_LENGTHS = ["V", "v", "deg"]


def unit_of_range(span: Column) -> Column:
    out = F.when(span.isNull(), F.lit(None).cast("string"))
    for limit, unit in RANGE_UNITS:
        out = out.when(span > limit, unit)
    return out.otherwise("m")


def guess_units(pixels: DataFrame) -> DataFrame:
    """(stack_id, unit): by the range of the finite values; null for a stack that has none."""
    z = F.when(finite(F.col("z")), F.col("z"))
    return pixels.groupBy("stack_id").agg((F.max(z) - F.min(z)).alias("span")).select("stack_id", unit_of_range(F.col("span")).alias("unit"))


def factor_of(unit: Column) -> Column:
    out = F.when(unit.isNull(), F.lit(1.0))
    for name, factor in TO_NM.items():
        out = out.when(unit == name, factor)
    return out.otherwise(F.raise_error(F.concat(F.lit("no length unit: "), unit)).cast("double"))


def to_nm(pixels: DataFrame, unit: str) -> DataFrame:
    if unit not in TO_NM:
        raise ValueError(f"{unit!r} is no length unit; known are {', '.join(TO_NM)}")
    return pixels.withColumn("z", F.col("z") * TO_NM[unit])


def guess_to_nm(pixels: DataFrame) -> DataFrame:
    """Each stack in nanometres by its guessed unit; a stack without finite values stays.

    The units, one row for each stack, are joined back; Spark broadcasts them if they are small.
    """
    joined = pixels.join(guess_units(pixels), "stack_id")
    return joined.withColumn("z", F.col("z") * factor_of(F.col("unit"))).drop("unit")


def by_declared_unit(pixels: DataFrame, unit: str | None) -> DataFrame:
    """A length is converted, V and deg stay, anything else is guessed."""
    if unit in TO_NM:
        return to_nm(pixels, unit)
    return pixels if unit in NOT_LENGTHS else guess_to_nm(pixels)


def by_channel(pixels: DataFrame, channel: str) -> DataFrame:
    """Only the topography channel TP is a length to be guessed."""
    return guess_to_nm(pixels) if channel == "TP" else pixels
