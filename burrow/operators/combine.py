"""Joins and spatial selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from burrow.functions.predicates import Filter, everything, near
from burrow.operators.retrieve import select


def join(left: DataFrame, right: DataFrame, left_field: str, right_field: str, left_name: str, right_name: str, fields: list[str] | None = None) -> DataFrame:
    """Inner join on one field of each side; every column becomes `<bucket>.<field>`. Keys of different types meet as text."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns if c != "bucket"])

    a, b = F.col(f"`{left_name}.{left_field}`"), F.col(f"`{right_name}.{right_field}`")
    if left.schema[left_field].dataType != right.schema[right_field].dataType:
        a, b = a.cast("string"), b.cast("string")
    joined = named(left, left_name).join(named(right, right_name), a == b, "inner")
    return joined if fields is None else joined.select(*[F.col(f"`{f}`") for f in fields])


def spatial_select(
    df: DataFrame, field: str, lat: float, lon: float, radius_km: float, where: Filter | None = None, sort: str | None = None, circle: bool = False
) -> DataFrame:
    """Documents in the box around a circle (or in the circle) that also match a filter."""
    return select(df, near(field, lat, lon, radius_km, circle) & (where or everything()), sort=sort)
