"""Spatial joins of tokens with regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

INSIDE, TOUCH = 0.85, 20.0
#: Side of a grid cell, in pixels.
CELL = 100.0


def _cells(df: DataFrame, halo: float, cell: float, x: str, y: str) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - halo) / cell), F.floor((F.col(hi) + halo) / cell))
    return df.withColumn(x, F.explode(span("x1", "x2"))).withColumn(y, F.explode(span("y1", "y2")))


def grid_join(left: DataFrame, right: DataFrame, on: list[str], halo: float = 0.0, cell: float = CELL) -> DataFrame:
    """All pairs of boxes of a group (`on`) that meet once right ones are widened by
    `halo` on all sides. Right columns keep their names under the prefix r_.

    Both sides are put into the grid cells they cover and joined on the cell, so
    the work follows the pairs that share one. A pair is kept only in the cell of
    the larger of its lower corners, which both have, so no duplicates arise. The sides
    are never broadcast: Spark judges their size before they are put into cells."""
    a = _cells(left, 0.0, cell, "_cx", "_cy")
    b = _cells(right, halo, cell, "_cx", "_cy")
    keys = [*on, "_cx", "_cy"]
    b = b.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    lower = lambda c: F.floor(F.greatest(F.col(c), F.col(f"r_{c}") - halo) / cell)
    meet = (F.col("x1") <= F.col("r_x2") + halo) & (F.col("x2") >= F.col("r_x1") - halo) & (F.col("y1") <= F.col("r_y2") + halo) & (F.col("y2") >= F.col("r_y1") - halo)
    return a.join(b.hint("merge"), keys).where(meet & (F.col("_cx") == lower("x1")) & (F.col("_cy") == lower("y1"))).drop("_cx", "_cy")


def violations(space_a: Column, space_b: Column, page_a: tuple[Column, Column], page_b: tuple[Column, Column]) -> Column:
    """Why two boxes may not be compared: the list of broken coordinate rules."""
    return F.array_compact(
        F.array(
            F.when(space_a != "page_pixels", "token not in page pixels"),
            F.when(space_b != "page_pixels", "region not in page pixels"),
            F.when((page_a[0] != page_b[0]) | (page_a[1] != page_b[1]), "page sizes differ"),
        )
    )


def rejected(tokens: DataFrame, regions: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """The coordinate firewall: pairs of a group that break a coordinate rule, as evidence
    that crosses with a score of 0. Both sides have space, page_w and page_h. Only
    spaces and page sizes decide, so those are paired, and then their members. Regions grow
    with the input, so they are not broadcast, however small their file."""
    keys, own = list(on), ("space", "page_w", "page_h")
    kinds = tokens.select(*keys, *own).distinct().join(regions.select(*keys, *[F.col(c).alias(f"r_{c}") for c in own]).distinct().hint("merge"), keys)
    broken = kinds.withColumn("violations", violations(F.col("space"), F.col("r_space"), (F.col("page_w"), F.col("page_h")), (F.col("r_page_w"), F.col("r_page_h")))).where(F.size("violations") > 0)
    out = tokens.select(*keys, "token_id", *own).join(broken, [*keys, *own]).join(regions.select(*keys, "region_id", *[F.col(c).alias(f"r_{c}") for c in own]).hint("merge"), [*keys, *[f"r_{c}" for c in own]])
    return out.select(*keys, "token_id", "region_id", F.lit("crosses").alias("cls"), F.lit(0.0).alias("score"), "violations")


def checked_align(tokens: DataFrame, regions: DataFrame, on: tuple[str, ...] = ("page",), cell: float = CELL) -> DataFrame:
    """align() of pairs that keep the coordinate rules, and the rejected pairs with their violations."""
    keys, sized = list(on), ("page_w", "page_h")
    good = lambda df: df.where(F.col("space") == "page_pixels")
    own = align(good(tokens), good(regions), (*on, *sized), cell).withColumn("violations", F.array().cast("array<string>"))
    return own.select(*keys, "token_id", "region_id", "cls", "score", "violations").unionByName(rejected(tokens, regions, on))


def align(tokens: DataFrame, regions: DataFrame, on: tuple[str, ...] = ("page",), cell: float = CELL) -> DataFrame:
    """Every match of a token with a region: inside if at least 0.85 of the token is
    covered (score: coverage), crosses if they overlap (score: IoU), touching if it is
    within 20 pixels (score falls with the distance of centres, at least 0.1)."""
    pairs = grid_join(tokens, regions, list(on), TOUCH, cell)
    t, r = g.box(), g.box("r_")
    pairs = pairs.withColumns({"_common": g.intersection(t, r), "iou": F.round(g.iou(t, r), 4), "coverage": F.round(g.coverage(t, r), 4), "region_coverage": F.round(g.coverage(r, t), 4), "distance": F.round(g.center_distance(t, r), 2)})
    near = (F.col("x1") < F.col("r_x2") + TOUCH) & (F.col("x2") > F.col("r_x1") - TOUCH) & (F.col("y1") < F.col("r_y2") + TOUCH) & (F.col("y2") > F.col("r_y1") - TOUCH)
    cls = F.when(F.col("coverage") >= INSIDE, "inside").when(F.col("_common") > 0, "crosses").when(near, "touching")
    score = F.when(F.col("cls") == "inside", F.col("coverage")).when(F.col("cls") == "crosses", F.col("iou")).otherwise(F.greatest(F.lit(0.1), 1 - F.col("distance") / 100))
    out = pairs.withColumn("cls", cls).where("cls is not null").withColumn("score", score)
    return out.select(*on, "token_id", F.col("r_region_id").alias("region_id"), "cls", "score", "iou", F.round("_common", 2).alias("intersection"), "coverage", "region_coverage", "distance")


def score_assignments(tokens: DataFrame, regions: DataFrame, walls: DataFrame | None = None, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Candidates by 0.7 coverage + 0.3 IoU, without those behind a wall: a box under
    10 pixels wide strictly between both centres, where token and region share heights."""
    pairs = grid_join(tokens, regions, list(on))
    t, r = g.box(), g.box("r_")
    if walls is not None:
        w = walls.where(F.col("x2") - F.col("x1") < 10).select(*on, F.col("x1").alias("_wall"))
        level = F.greatest("y1", "r_y1") < F.least("y2", "r_y2")
        tx, rx = g.x_center(t), g.x_center(r)
        between = (F.col("_wall") > F.least(tx, rx)) & (F.col("_wall") < F.greatest(tx, rx))
        same = [pairs[c] == w[c] for c in on]
        cond = level & between
        for s in same:
            cond &= s
        pairs = pairs.join(w, cond, "left_anti")
    score = 0.7 * g.coverage(t, r) + 0.3 * g.iou(t, r)
    return pairs.select(*on, "token_id", F.col("r_region_id").alias("region_id"), score.alias("score"))


def best_assignment(tokens: DataFrame, scored: DataFrame, on: tuple[str, ...] = ("page",), least: float = 0.2) -> DataFrame:
    """The best region of each token (the smaller id at equal scores); orphaned
    without any candidate or below the least score."""
    keys = [*on, "token_id"]
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.col("score"), (-F.col("region_id")).alias("_r"))).alias("b")).select(*keys, F.col("b.score").alias("score"), (-F.col("b._r")).alias("region_id"))
    out = tokens.select(*keys).join(best, keys, "left")
    return out.withColumn("orphaned", F.coalesce(F.col("score") < least, F.lit(True)))


def nearest_region(tokens: DataFrame, regions: DataFrame, radius: float = 50.0, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """The region with the nearest edge within a radius of each token, if there is one."""
    pairs = grid_join(tokens, regions, list(on), radius)
    d = g.edge_distance(g.box(), g.box("r_"))
    near = pairs.withColumn("distance", d).where(F.col("distance") < radius)
    best = near.groupBy(*on, "token_id").agg(F.min(F.struct(F.col("distance"), F.col("r_region_id").alias("region_id"))).alias("b"))
    return best.select(*on, "token_id", F.col("b.region_id").alias("region_id"), F.col("b.distance").alias("distance"))


def validate_assignments(assigned: DataFrame, regions: DataFrame, on: tuple[str, ...] = ("page",), most_orphans: float = 0.4) -> DataFrame:
    """Per group: share of orphans, regions that don't exist, tokens given twice, and consistent."""
    keys = list(on)
    known = regions.select(*keys, "region_id").distinct().withColumn("_known", F.lit(True))
    rows = assigned.join(known.hint("merge"), [*keys, "region_id"], "left")
    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if("orphaned").alias("orphans"),
        F.count_if(F.col("region_id").isNotNull() & F.col("_known").isNull()).alias("unknown_regions"),
        (F.count(F.lit(1)) - F.countDistinct("token_id")).alias("repeated"),
    )
    ok = (F.col("orphans") <= most_orphans * F.col("tokens")) & (F.col("unknown_regions") == 0) & (F.col("repeated") == 0)
    return per.withColumn("consistent", ok)


def point_hits(points: DataFrame, regions: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """The first region (by id) under each point (px, py)."""
    dots = points.withColumns({"x1": F.col("px"), "x2": F.col("px"), "y1": F.col("py"), "y2": F.col("py")})
    return grid_join(dots, regions, list(on)).groupBy(*on, "point_id").agg(F.min("r_region_id").alias("region_id"))


def containment(regions: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Each region with its parent: the largest region that holds it; null for roots."""
    pairs = grid_join(regions, regions, list(on), 5.0)
    inner, outer = g.box(), g.box("r_")
    held = pairs.where((F.col("region_id") != F.col("r_region_id")) & g.contains(outer, inner))
    parent = held.groupBy(*on, "region_id").agg(F.max(F.struct(g.area(outer).alias("a"), (-F.col("r_region_id")).alias("r"))).alias("p")).select(*on, "region_id", (-F.col("p.r")).alias("parent_id"))
    return regions.select(*on, "region_id").join(parent.hint("merge"), [*on, "region_id"], "left")


def nested_grids(grids: DataFrame, cells: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Grids that lie in a cell of another grid, with a margin of 10 pixels and an
    area under 0.85 of the cell's."""
    pairs = grid_join(grids, cells, list(on), 10.0)
    inner, outer = g.box(), g.box("r_")
    held = (outer[0] <= inner[0] + 10) & (outer[1] <= inner[1] + 10) & (outer[2] >= inner[2] - 10) & (outer[3] >= inner[3] - 10) & (g.area(inner) < 0.85 * g.area(outer))
    return pairs.where((F.col("grid_id") != F.col("r_grid_id")) & held).select(*on, "grid_id").distinct()
