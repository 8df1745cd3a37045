"""Box geometry in 32-bit floats, as Columns.

Quotients of floats are doubles in Spark, so each is cast back; that double
quotient rounds to the same float as a float division.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where plain nesting would repeat its expression."""
    return F.get(F.transform(F.array(value), body), 0)


def computed(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Rows with columns that later expressions refer to: a generator, through which nothing is inlined.

    Deep expressions else repeat the lower ones and outgrow what the JVM compiles.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def clamp(value: Column, high: Column) -> Column:
    """Into [0, high]; NaN stays NaN."""
    return F.when(F.isnan(value), value).otherwise(F.least(F.greatest(value, f32(0.0)), high))


def extent(low: Column, high: Column) -> Column:
    """high - low, at least 0; 0 if either is NaN."""
    d = high - low
    return F.when(F.isnan(d), f32(0.0)).otherwise(F.greatest(d, f32(0.0)))


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


def clamped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Box:
    """Corner coordinates cut to the page; inverted boxes have no extent."""
    wide, high = f32(width), f32(height)
    left, top = clamp(x1, wide), clamp(y1, high)
    return Box(left, top, extent(left, clamp(x2, wide)), extent(top, clamp(y2, high)))


def edges(box: Box) -> dict[str, Column]:
    """What overlap needs of a box, so that each is computed once.

    A NaN edge yields to the other box's: minus infinity as a low edge and
    infinity as a high one do the same.
    """
    low = lambda v: F.when(F.isnan(v), f32(-INF)).otherwise(v)
    high = lambda v, d: F.when(F.isnan(v), f32(INF)).otherwise(v + d)
    return {"l": low(box.x), "t": low(box.y), "r": high(box.x, box.w), "b": high(box.y, box.h), "area": box.w * box.h}


class Overlap(NamedTuple):
    intersection: Column
    min_area: Column
    union: Column

    @property
    def iou(self) -> Column:
        return _share(self.intersection, self.union)

    @property
    def score(self) -> Column:
        """The stronger of IoU and coverage of the smaller box."""
        return F.greatest(self.iou, self.cover)

    @property
    def cover(self) -> Column:
        return _share(self.intersection, self.min_area)

    def score_above(self, bound: Column) -> Column:
        """Whether the score is above ``bound``, without both quotients where one tells."""
        return (self.cover > bound) | (self.iou > bound)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, f32(0.0)).otherwise((part / whole).cast("float"))


def common(low_a: Column, low_b: Column, high_a: Column, high_b: Column) -> Column:
    d = F.least(high_a, high_b) - F.greatest(low_a, low_b)
    return F.when(d == INF, f32(0.0)).otherwise(F.greatest(d, f32(0.0)))  # infinite only if both are NaN


def touches(a: Column | dict, b: Column | dict) -> Column:
    """Whether two boxes may share area: cheap, and false only if the intersection is zero."""
    return (a["l"] < b["r"]) & (b["l"] < a["r"]) & (a["t"] < b["b"]) & (b["t"] < a["b"])


def shared_sides(a: Column | dict, b: Column | dict) -> tuple[Column, Column]:
    """Width and height of what two boxes share."""
    return common(a["l"], b["l"], a["r"], b["r"]), common(a["t"], b["t"], a["b"], b["b"])


def overlap(a: Column | dict, b: Column | dict) -> Overlap:
    """Overlap of two boxes given by the fields of :func:`edges`, as structs or dicts of columns."""
    w, h = shared_sides(a, b)
    return overlap_of(w, h, a["area"], b["area"])


def overlap_of(w: Column, h: Column, area_a: Column, area_b: Column) -> Overlap:
    return Overlap(w * h, F.least(area_a, area_b), area_a + area_b - w * h)
