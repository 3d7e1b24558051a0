"""Missing values: NULL is the only missing marker inside the library."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def nan_to_null(value: Column) -> Column:
    """NaN poisons averages and sorts greatest in Spark, so it never goes past a boundary."""
    return F.when(~F.isnan(value), value)


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < INFINITY), value)


def sentinel_to_null(value: Column, sentinel: float = -1.0) -> Column:
    return F.nullif(value, F.lit(sentinel))


def is_missing(value: Column, sentinels: tuple[float, ...] = (0.0, -1.0)) -> Column:
    """NULL, NaN or one of the given marker values. Never NULL itself."""
    missing = value.isNull() | F.isnan(value)
    if sentinels:
        missing = missing | F.coalesce(value.isin(*sentinels), F.lit(False))
    return missing


def fill_missing(value: Column, fill: float = 1.0, sentinels: tuple[float, ...] = (0.0, -1.0)) -> Column:
    return F.when(is_missing(value, sentinels), F.lit(fill)).otherwise(value)


def mask_missing(value: Column, sentinels: tuple[float, ...] = (0.0, -1.0)) -> Column:
    return F.when(~is_missing(value, sentinels), value)
