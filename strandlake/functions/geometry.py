"""Scalar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def is_collision(d2: Column, radius: float) -> Column:
    return d2 <= (2 * radius) ** 2


def is_neighbour(d2: Column, reach: float) -> Column:
    return d2 <= reach * reach


def contact_bounds(radius: float, scale: float = 1.02) -> tuple[float, float]:
    """Squared inner and outer contact distance of two discs."""
    return (2 * radius * scale * 0.98) ** 2, (2 * radius * scale) ** 2


def relative_angle(rotation: Column, angle: Column) -> Column:
    return F.pmod(angle - rotation, F.lit(360))


def box_coordinate(v: Column, side: int) -> Column:
    """Box from 1; negative values are cut towards zero."""
    return (F.when(v >= 0, F.floor(v / side)).otherwise(F.ceil(v / side)) + 1).cast("long")


def ceil_to(v: Column, step: Column) -> Column:
    return F.ceil(v / step) * step


def ticks(last: Column, step: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.round(last / step).cast("int")), lambda i: i * step)
