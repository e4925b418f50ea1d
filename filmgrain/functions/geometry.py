"""Normalised-box expressions. Column names: x_min, y_min, x_max, y_max."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmgrain.config import Framing
from filmgrain.functions.numeric import clip, dbl

FRAMING_ORDER = (
    "EXTREME_WIDE_ESTIMATE",
    "WIDE_ESTIMATE",
    "MEDIUM_ESTIMATE",
    "CLOSE_UP_ESTIMATE",
    "EXTREME_CLOSE_UP_ESTIMATE",
    "UNDETERMINED",
)


def centroid_x() -> Column:
    return (F.col("x_min") + F.col("x_max")) / dbl(2)


def centroid_y() -> Column:
    return (F.col("y_min") + F.col("y_max")) / dbl(2)


def box_height() -> Column:
    return F.col("y_max") - F.col("y_min")


def box_area() -> Column:
    return (F.col("x_max") - F.col("x_min")) * box_height()


def truncated(edge: float) -> Column:
    return (F.col("y_min") <= dbl(edge)) & (F.col("y_max") >= dbl(1.0 - edge))


def iou(p: str, q: str) -> Column:
    """Overlap over union of two struct columns that hold a box each."""
    def c(s, n):
        return F.col(f"{s}.{n}")

    def area(s):
        return (c(s, "x_max") - c(s, "x_min")) * (c(s, "y_max") - c(s, "y_min"))

    w = F.greatest(dbl(0), F.least(c(p, "x_max"), c(q, "x_max")) - F.greatest(c(p, "x_min"), c(q, "x_min")))
    h = F.greatest(dbl(0), F.least(c(p, "y_max"), c(q, "y_max")) - F.greatest(c(p, "y_min"), c(q, "y_min")))
    union = area(p) + area(q) - w * h
    return F.when(union <= 0, dbl(0)).otherwise(w * h / union)


def proximity(distance: Column, sigma: float) -> Column:
    if sigma <= 0:
        return dbl(0)
    z = distance / dbl(sigma)
    return clip(F.exp(-(z * z)))


def _distance(x: Column, y: Column, tx: float, ty: float) -> Column:
    dx, dy = x - dbl(tx), y - dbl(ty)
    return F.sqrt(dx * dx + dy * dy)


def thirds_proximity(x: Column, y: Column, sigma: float) -> Column:
    grid = [(i / 3.0, j / 3.0) for j in (1, 2) for i in (1, 2)]
    return proximity(F.least(*[_distance(x, y, *p) for p in grid]), sigma)


def centre_proximity(x: Column, y: Column, sigma: float) -> Column:
    return proximity(_distance(x, y, 0.5, 0.5), sigma)


def framing_label(rules: Framing) -> Column:
    h = box_height()
    return (
        F.when(truncated(rules.edge_truncation), "EXTREME_CLOSE_UP_ESTIMATE")
        .when(h < rules.extreme_wide_height_max, "EXTREME_WIDE_ESTIMATE")
        .when(h < rules.wide_height_max, "WIDE_ESTIMATE")
        .when(h < rules.medium_height_max, "MEDIUM_ESTIMATE")
        .when(h < rules.close_up_height_max, "CLOSE_UP_ESTIMATE")
        .otherwise("EXTREME_CLOSE_UP_ESTIMATE")
    )


def threshold_margin(height: Column, rules: Framing) -> Column:
    """Distance to the nearest framing bound, scaled so 0.08 of a frame is full."""
    bounds = [
        0.0,
        rules.extreme_wide_height_max,
        rules.wide_height_max,
        rules.medium_height_max,
        rules.close_up_height_max,
        1.0,
    ]
    return clip(F.least(*[F.abs(height - dbl(b)) for b in bounds]) / dbl(0.08))
