"""Boxes, affine maps and theta joins of boxes. Joins always carry an equality (the page), so they run as hash or merge joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def sides(alias: str) -> list[Column]:
    return [F.col(f"{alias}.{s}") for s in SIDES]


def overlap(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Width and height of the common part; 0 where there is none."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])), F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def area(a: list[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def intersects(a: list[Column], b: list[Column]) -> Column:
    """Strictly: boxes that only touch don't."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(a: list[Column], b: list[Column], tolerance: float = 0.0) -> Column:
    return (a[0] <= b[0] + tolerance) & (a[1] <= b[1] + tolerance) & (a[2] >= b[2] - tolerance) & (a[3] >= b[3] - tolerance)


def iou(a: list[Column], b: list[Column]) -> Column:
    w, h = overlap(a, b)
    return w * h / (area(a) + area(b) - w * h)


def pairs(boxes: DataFrame, page: str, ident: str) -> DataFrame:
    """Ordered pairs (a before b by `ident`) of boxes of one page; a page's boxes are few."""
    a, b = boxes.alias("a"), boxes.alias("b")
    return a.join(b, (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")))


def affine(m: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return F.lit(a) * x + F.lit(c) * y + F.lit(e), F.lit(b) * x + F.lit(d) * y + F.lit(f)


def inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    """The inverse map; a map without one is an error."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    if abs(det) < 1e-12:
        raise ValueError("the map has no inverse")
    return d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det


def mapped(m: tuple[float, ...], box: list[Column]) -> list[Column]:
    """Box around the four mapped corners, cut to 0..1."""
    corners = [affine(m, box[i], box[j]) for i in (0, 2) for j in (1, 3)]
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [clip(F.least(*xs)), clip(F.least(*ys)), clip(F.greatest(*xs)), clip(F.greatest(*ys))]


def pixels(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Whole pixels around a box of fractions: floor and ceiling within the page."""
    cut = lambda v, n: F.greatest(F.lit(0), F.least(v, n)).cast("bigint")
    return [cut(F.floor(box[0] * width), width), cut(F.floor(box[1] * height), height), cut(F.ceil(box[2] * width), width), cut(F.ceil(box[3] * height), height)]


def grown(boxes: DataFrame, page: str) -> DataFrame:
    """Boxes of each page grown to the union with every box they meet until nothing changes (page, boxes left, their area).

    Sequential by nature, so each page's boxes, which are few, are gathered and settled in an Arrow function.
    """

    def settle(left: list[dict]) -> tuple[int, float]:
        now = sorted(tuple(b[s] for s in SIDES) for b in left)
        changed = True
        while changed:
            changed, out = False, []
            for b in now:
                for i, o in enumerate(out):
                    if o[0] < b[2] and b[0] < o[2] and o[1] < b[3] and b[1] < o[3]:
                        out[i] = (min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]))
                        changed = True
                        break
                else:
                    out.append(b)
            now = out
        return len(now), round(sum((b[2] - b[0]) * (b[3] - b[1]) for b in now), 6)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [settle(x) for x in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(page), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64())], names=[page, "boxes", "area"])

    whole = boxes.where(" and ".join(f"{s} is not null" for s in SIDES))
    return whole.groupBy(page).agg(F.collect_list(F.struct(*SIDES)).alias("b")).mapInArrow(run, f"{page} string, boxes long, area double")


def band_score(x0: Column, y0: Column, x1: Column, y1: Column, u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """The shares of the smaller height and width that two boxes have in common, multiplied, less 0.3 of their centres' vertical distance
    in heights of the taller. Both boxes have a height and a width."""
    high = F.greatest(F.lit(0.0), F.least(y1, v1) - F.greatest(y0, v0)) / F.least(y1 - y0, v1 - v0)
    wide = F.greatest(F.lit(0.0), F.least(x1, u1) - F.greatest(x0, u0)) / F.least(x1 - x0, u1 - u0)
    return high * wide - F.abs((y0 + y1 - v0 - v1) / 2) / F.greatest(y1 - y0, v1 - v0) * 0.3
