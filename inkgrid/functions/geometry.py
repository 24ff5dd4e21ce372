"""Box geometry as column expressions. A box is four columns x1, y1, x2, y2, so
that range predicates on them reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VISION_DPI = 300


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def width(b) -> Column:
    return b[2] - b[0]


def height(b) -> Column:
    return b[3] - b[1]


def area(b) -> Column:
    return width(b) * height(b)


def x_center(b) -> Column:
    return (b[0] + b[2]) / 2


def y_center(b) -> Column:
    return (b[1] + b[3]) / 2


def intersection(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a, b) -> Column:
    common = intersection(a, b)
    return _ratio(common, area(a) + area(b) - common)


def coverage(a, b) -> Column:
    """The share of box a that lies in box b."""
    return _ratio(intersection(a, b), area(a))


def center_distance(a, b) -> Column:
    return F.hypot(x_center(a) - x_center(b), y_center(a) - y_center(b))


def edge_distance(a, b) -> Column:
    """The distance between the nearest edges; 0 if the boxes meet."""
    dx = F.greatest(b[0] - a[2], a[0] - b[2], F.lit(0.0))
    dy = F.greatest(b[1] - a[3], a[1] - b[3], F.lit(0.0))
    return F.hypot(dx, dy)


def contains(outer, inner, margin: float = 5.0, ratio: float = 1.2) -> Column:
    """Whether outer holds inner, up to a margin, and is larger by a ratio of areas."""
    return (outer[0] <= inner[0] + margin) & (outer[1] <= inner[1] + margin) & (outer[2] >= inner[2] - margin) & (outer[3] >= inner[3] - margin) & (area(outer) > area(inner) * ratio)


def normalized(b, space: Column, page_w: Column, page_h: Column) -> list[Column]:
    """The box in parts of the page; as it is if it is in them already."""
    own = space == "normalized"
    sizes = (page_w, page_h, page_w, page_h)
    return [F.when(own, c).otherwise(c / s) for c, s in zip(b, sizes, strict=True)]


def pixels(b, space: Column, page_w: Column, page_h: Column) -> list[Column]:
    """The box in page pixels; boxes in points are an error."""
    sizes = (page_w, page_h, page_w, page_h)
    bad = F.raise_error(F.lit("a box in points has no page pixels"))
    return [F.when(space == "page_pixels", c).when(space == "normalized", c * s).otherwise(bad) for c, s in zip(b, sizes, strict=True)]


def project(v: Column, scale: Column, offset: Column) -> Column:
    return v * scale + offset


def unproject(v: Column, scale: Column, offset: Column) -> Column:
    """The inverse of project; 0 where the scale is 0."""
    return F.when(scale != 0, (v - offset) / scale).otherwise(0.0)


def dpi_scale(source_dpi: Column) -> Column:
    return F.lit(float(VISION_DPI)) / source_dpi


TRACE = ("source_space", "target_space", "scale_x", "scale_y", "offset_x", "offset_y", "rotation", "dpi_before", "dpi_after")


def _trace(source: Column, target: Column, scale: tuple[Column, Column], offset: tuple[Column, Column], rotation: Column, before: Column, after: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((source, target, *scale, *offset, rotation, before.cast("int"), after.cast("int")), TRACE, strict=True)])


def identity_trace(space: Column) -> Column:
    """The trace of a page on which nothing is changed."""
    one, zero, none = F.lit(1.0), F.lit(0.0), F.lit(None)
    return _trace(space, space, (one, one), (zero, zero), zero, none, none)


def dpi_trace(source_dpi: Column) -> Column:
    """From page pixels to pages of VISION_DPI."""
    zero, scale = F.lit(0.0), dpi_scale(source_dpi)
    return _trace(F.lit("page_pixels"), F.lit(f"normalized_opencv_{VISION_DPI}dpi"), (scale, scale), (zero, zero), zero, source_dpi, F.lit(VISION_DPI))


def _further(trace: Column, suffix: str, offset: tuple[Column, Column], rotation: Column) -> Column:
    return _trace(trace["target_space"], F.concat(trace["target_space"], F.lit(suffix)), (trace["scale_x"], trace["scale_y"]), offset, rotation, trace["dpi_after"], trace["dpi_after"])


def crop_trace(trace: Column, x: Column, y: Column) -> Column:
    return _further(trace, "_cropped", (trace["offset_x"] + x, trace["offset_y"] + y), F.lit(0.0))


def deskew_trace(trace: Column, degrees: Column) -> Column:
    """The angle is kept for audits; boxes aren't turned."""
    return _further(trace, "_deskewed", (trace["offset_x"], trace["offset_y"]), degrees)


def traced(b, trace: Column, back: bool = False) -> list[Column]:
    """A box taken along a trace, or back."""
    move = unproject if back else project
    return [move(c, trace[f"scale_{a}"], trace[f"offset_{a}"]) for c, a in zip(b, "xyxy", strict=True)]


def normalized_regions(boxes: Column, page_w: Column, page_h: Column) -> Column:
    """An array of boxes (x1, y1, x2, y2, space) in parts of the page."""
    def one(x: Column) -> Column:
        own = normalized([x[c] for c in ("x1", "y1", "x2", "y2")], x["space"], page_w, page_h)
        return F.struct(*[c.alias(n) for c, n in zip(own, ("x1", "y1", "x2", "y2"), strict=True)], F.lit("normalized").alias("space"))

    return F.transform(boxes, one)


def overlaps(a, b, space_a: Column, space_b: Column, least: float = 0.25) -> Column:
    """Whether two boxes of one space have enough in common; never in different spaces."""
    return (space_a == space_b) & (iou(a, b) >= least)


def padded(b, least: float = 0.1) -> list[Column]:
    """The box with degenerate sides widened a little."""
    return [b[0], b[1], F.when(b[2] <= b[0], b[0] + least).otherwise(b[2]), F.when(b[3] <= b[1], b[1] + least).otherwise(b[3])]


def polygon_box(polygon: Column) -> list[Column]:
    """The upright box about a polygon, an array of [x, y]."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def clamped(b, page_w: Column, page_h: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [F.least(F.greatest(c, zero), s) for c, s in zip(b, (page_w, page_h, page_w, page_h), strict=True)]


def evidence_score(geometry: Column, text: Column, structure: Column) -> Column:
    return F.least(F.round(0.35 * geometry + 0.45 * text + 0.20 * structure, 4), F.lit(1.0))


def hex_color(blue: Column, green: Column, red: Column) -> Column:
    return F.format_string("#%02x%02x%02x", red, green, blue)
