"""Expressions over boxes: arrays x0, y0, x1, y1 of page pixels, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corner(box: Column, i: int) -> Column:
    """Coordinate i (0 to 3) of a box; null where the box is null or too short."""
    return F.try_element_at(box, F.lit(i + 1))


def width(box: Column) -> Column:
    return corner(box, 2) - corner(box, 0)


def height(box: Column) -> Column:
    return corner(box, 3) - corner(box, 1)


def centre_y(box: Column) -> Column:
    return (corner(box, 1) + corner(box, 3)) / 2


def area(box: Column) -> Column:
    return F.greatest(width(box), F.lit(0)).cast("bigint") * F.greatest(height(box), F.lit(0))


def overlap(a: Column, b: Column, axis: int) -> Column:
    """Shared length along x (axis 0) or y (axis 1); 0 for boxes apart."""
    return F.greatest(F.least(corner(a, axis + 2), corner(b, axis + 2)) - F.greatest(corner(a, axis), corner(b, axis)), F.lit(0))


def shared_area(a: Column, b: Column) -> Column:
    return overlap(a, b, 0).cast("bigint") * overlap(a, b, 1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    both = shared_area(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def inside(point_x: Column, point_y: Column, box: Column, margin: int = 5) -> Column:
    return point_x.between(corner(box, 0) - margin, corner(box, 2) + margin) & point_y.between(corner(box, 1) - margin, corner(box, 3) + margin)


def same_row(a: Column, b: Column, share: float = 0.5) -> Column:
    """Whether two boxes overlap vertically by more than ``share`` of the lower one."""
    return overlap(a, b, 1) > share * F.least(height(a), height(b))


def expanded(box: Column, pad: Column, page_width: Column, page_height: Column) -> Column:
    """A box grown on all sides and kept on its page."""
    zero = F.lit(0)
    return F.array(F.greatest(corner(box, 0) - pad, zero), F.greatest(corner(box, 1) - pad, zero), F.least(corner(box, 2) + pad, page_width), F.least(corner(box, 3) + pad, page_height))


def scaled(box: Column, factor: Column) -> Column:
    """A box in another pixel space; halves go to the even integer."""
    return F.transform(box, lambda v: F.bround(v * factor).cast("int"))
