"""Box expressions: l, t, w, h in page units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(p: str = "") -> Column:
    return F.col(f"{p}l") + F.col(f"{p}w")


def bottom(p: str = "") -> Column:
    return F.col(f"{p}t") + F.col(f"{p}h")


def area(p: str = "") -> Column:
    return F.col(f"{p}w") * F.col(f"{p}h")


def centre_x(p: str = "") -> Column:
    return F.col(f"{p}l") + F.col(f"{p}w") / 2


def centre_y(p: str = "") -> Column:
    return F.col(f"{p}t") + F.col(f"{p}h") / 2


def overlap(a: str, b: str) -> Column:
    """Area of the intersection over the smaller area; 0 where that is 0."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(hi(a), hi(b)) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    return F.coalesce(F.try_divide(side("l", right) * side("t", bottom), F.least(area(a), area(b))), F.lit(0.0))


def gap_distance(a: str, b: str) -> Column:
    """Distance between two boxes; infinite where no strict gap parts them."""
    dx = F.greatest(F.col(f"{b}l") - right(a), F.col(f"{a}l") - right(b), F.lit(0.0))
    dy = F.greatest(F.col(f"{b}t") - bottom(a), F.col(f"{a}t") - bottom(b), F.lit(0.0))
    return F.when((dx == 0) & (dy == 0), F.lit(float("inf"))).otherwise(F.sqrt(dx * dx + dy * dy))


def crop_window(size: int, pad: float, wide: bool = True) -> list[Column]:
    """Pixel bounds x0, y0, x1, y1 of a padded crop, clamped to the page; rounding is half-even.

    The padding in y is a share of the crop's height; in x it is the same, or three heights for crops that are not wider than high (`wide`)."""
    edge = lambda x: F.bround(x * size).cast("int")
    high, broad = edge(bottom()) - edge(F.col("t")), edge(right()) - edge(F.col("l"))
    y_pad = F.floor(F.lit(pad) * high).cast("int")
    x_pad = F.when(high < broad, y_pad).otherwise(3 * high) if wide else y_pad
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(size), x))
    return [clamp(edge(F.col("l")) - x_pad).alias("x0"), clamp(edge(F.col("t")) - y_pad).alias("y0"), clamp(edge(right()) + x_pad).alias("x1"), clamp(edge(bottom()) + y_pad).alias("y1")]


def normalised_box(xs: Column, ys: Column, width: Column, height: Column) -> list[Column]:
    """l, t, w, h in page units of the box around vertices given in pixels."""
    l, t = F.array_min(xs) / width, F.array_min(ys) / height  # noqa: E741
    return [l.alias("l"), t.alias("t"), (F.array_max(xs) / width - l).alias("w"), (F.array_max(ys) / height - t).alias("h")]


def caps_class(text: Column) -> Column:
    """0 upper, 1 lower, 2 mixed or without case."""
    up, low = text.rlike(r"\p{Lu}"), text.rlike(r"\p{Ll}")
    return F.when(up & ~low, 0).when(low & ~up, 1).otherwise(2)


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten, rounded half away from 0 as a double, and divided again. F.round rounds the shortest decimal that names the double instead; where
    the product falls on a half, both can differ in the last digit."""
    scaled = F.abs(x) * 10.0**digits
    whole = F.floor(scaled)
    return F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 10.0**digits
