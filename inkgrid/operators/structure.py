"""Page structure from ruled lines: regions, zones, grids, merged cells, filled gaps.

Lines are rows of (page, line_id, orientation, axis, start, stop, confidence)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import islands, leader_axes, line_gaps, once

# Thresholds in pixels and in parts of the page.
SNAP, AXIS_NEAR, MAX_GAP, MIN_SCORE = 8.0, 12.0, 80.0, 0.55


def page_regions(lines: DataFrame, page_w: float, page_h: float, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Header above the first long rule (if it is in the top fifth) and footer below the last."""
    long_ = lines.where((F.col("orientation") == "horizontal") & (F.col("stop") - F.col("start") > page_w * 0.4))
    per = long_.groupBy(*on).agg(F.min("axis").alias("first"), F.max("axis").alias("last"))
    header = per.where((F.col("first") > 10) & (F.col("first") < page_h * 0.2)).select(*on, F.lit("header").alias("region_type"), F.lit(0.0).alias("y1"), F.col("first").alias("y2"), F.lit(0.85).alias("confidence"))
    footer = per.where(F.col("last") > page_h * 0.8).select(*on, F.lit("footer").alias("region_type"), F.col("last").alias("y1"), F.lit(page_h).alias("y2"), F.lit(0.8).alias("confidence"))
    return header.unionByName(footer)


def signature_areas(boxes: DataFrame, page_w: float, page_h: float) -> DataFrame:
    wide = (F.col("y1") > page_h * 0.7) & (F.col("x2") - F.col("x1") > page_w * 0.2)
    return boxes.where(F.col("box_type").isin("signature_box", "input_box") & wide).withColumns({"region_type": F.lit("signature_area"), "confidence": F.col("confidence") * 0.9})


def section_anchors(lines: DataFrame, page_w: float) -> DataFrame:
    """Horizontal rules over 55 percent of the page's width; from 85 percent, section boundaries."""
    span = F.col("stop") - F.col("start")
    kind = F.when(span >= page_w * 0.85, "section_boundary").otherwise("horizontal_rule")
    return lines.where((F.col("orientation") == "horizontal") & (span >= page_w * 0.55)).withColumn("anchor_type", kind)


def table_zones(lines: DataFrame, page_w: float, page_h: float, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Zones where two horizontal lines or more, close in y, meet two vertical ones or
    more. The last line of a page belongs to the group before it, however far it is."""
    keys = list(on)
    w = Window.partitionBy(*keys).orderBy("axis", "line_id")
    h = lines.where("orientation = 'horizontal'").withColumn("_last", F.lead("axis").over(w).isNull())
    new = (F.col("axis") - F.lag("axis").over(w) > page_h * 0.12) & ~F.col("_last")
    h = h.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("zone", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    groups = h.groupBy(*keys, "zone").agg(F.min("axis").alias("y1"), F.max("axis").alias("y2"), F.count(F.lit(1)).alias("n_h")).where("n_h >= 2")
    v = lines.where("orientation = 'vertical'").select(*keys, F.col("axis").alias("x"), "start", "stop")
    met = groups.join(v, keys).where(~((F.col("stop") < F.col("y1")) | (F.col("start") > F.col("y2"))))
    out = met.groupBy(*keys, "zone", "y1", "y2", "n_h").agg(F.count(F.lit(1)).alias("n_v"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n_v >= 2")
    return out.select(*keys, F.greatest(F.lit(0.0), F.col("lo") - 5).alias("x1"), "y1", F.least(F.lit(page_w), F.col("hi") + 5).alias("x2"), "y2", "n_h", "n_v")


def _grid_lines(lines: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Each page's grid, all crossings of its horizontal and vertical positions, as h and v: lists of
    the positions in order, each with `ls`, the steps between the positions across it that a detected
    line covers. A line lies more than the tolerance from the lines of other positions, so only those
    of its own can cover. A line covers the steps from the first that begins after its start to the
    last that ends before its stop, so it is looked at once, not for each step."""
    chained = islands(lines, F.col("axis"), tolerance, [*keys, "orientation"], "axis", "_g")
    ends = F.struct("axis", "start", "stop")
    own = chained.groupBy(*keys, "orientation", "_g").agg(F.avg("axis").alias("position"), F.collect_list(ends).alias("ls"))
    own = own.select(*keys, "orientation", F.struct("position", F.filter("ls", lambda x: F.abs(x["axis"] - F.col("position")) < tolerance).alias("ls")).alias("p"))
    at = lambda kind: F.sort_array(F.collect_list(F.when(F.col("orientation") == kind, F.col("p"))))
    pages = own.groupBy(*keys).agg(at("horizontal").alias("h"), at("vertical").alias("v")).where((F.size("h") >= 2) & (F.size("v") >= 2))

    def steps(x: Column, across: str) -> Column:
        first = F.size(F.filter(across, lambda p: x["start"] > p["position"] + tolerance))
        last = F.size(F.filter(across, lambda p: x["stop"] >= p["position"] - tolerance)) - 2
        return once(F.struct(first.alias("a"), last.alias("z")), lambda s: F.when(s["a"] <= s["z"], F.sequence(s["a"], s["z"])).otherwise(F.array().cast("array<int>")))

    def covered(along: str, across: str) -> Column:
        return F.transform(along, lambda line: F.struct(line["position"].alias("position"), F.flatten(F.transform(line["ls"], lambda x: steps(x, across))).alias("steps")))

    return pages.select(*keys, covered("h", "v").alias("h"), covered("v", "h").alias("v"))


def grid_edges(lines: DataFrame, on: tuple[str, ...] = ("page",), tolerance: float = SNAP) -> DataFrame:
    """The edges of each page's grid: orientation, row and col of their first node, the
    span, and is_inferred where no detected line covers them.

    Pages have one grid. Everything is made from one list of positions per page, whose size the
    page bounds."""
    keys = list(on)
    way = lambda kind, along, across: F.struct(F.lit(kind).alias("orientation"), F.col(along).alias("along"), F.col(f"{across}.position").alias("across"))
    sides = _grid_lines(lines, keys, tolerance).select(*keys, F.inline(F.array(way("horizontal", "h", "v"), way("vertical", "v", "h"))))
    edges = sides.select(*keys, "orientation", "across", F.posexplode("along").alias("_i", "_line"))
    edges = edges.select(*keys, "orientation", "across", "_i", "_line", F.posexplode("across").alias("_j", "from")).where(F.col("_j") < F.size("across") - 1)
    flat = F.col("orientation") == "horizontal"
    return edges.select(
        *keys, "orientation", F.when(flat, F.col("_i")).otherwise(F.col("_j")).alias("row"), F.when(flat, F.col("_j")).otherwise(F.col("_i")).alias("col"),
        F.col("_line.position").alias("axis"), "from", F.get("across", F.col("_j") + 1).alias("to"), (~F.array_contains("_line.steps", F.col("_j"))).alias("is_inferred"),
    )


def grids(edges: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Each page's grid: rows, columns, box, and its confidence (0.9, or 0.7 with inferred edges)."""
    horizontal, vertical = F.col("orientation") == "horizontal", F.col("orientation") == "vertical"
    per = edges.groupBy(*on).agg(
        F.max(F.when(horizontal, F.col("row"))).alias("n_rows"), F.max(F.when(vertical, F.col("col"))).alias("n_cols"),
        F.min(F.when(vertical, F.col("axis"))).alias("x1"), F.min(F.when(horizontal, F.col("axis"))).alias("y1"),
        F.max(F.when(vertical, F.col("axis"))).alias("x2"), F.max(F.when(horizontal, F.col("axis"))).alias("y2"), F.count_if("is_inferred").alias("n_inferred"),
    )
    return per.withColumn("confidence", F.when(F.col("n_inferred") > 0, 0.7).otherwise(0.9))


_MERGED = "root_row int, root_col int, row_start int, row_end int, col_start int, col_end int, rowspan int, colspan int, is_merged boolean, n_cells int, confidence double"
#: Grid cells that are merged at once, about; a larger page goes alone.
AT_ONCE = 1 << 19


def _merged(flat: np.ndarray, upright: np.ndarray, sizes: np.ndarray, max_span: int) -> list[np.ndarray]:
    """The page (by its number) and the columns of _MERGED of each merged cell. flat and upright
    (page, row, col) are true where the edge over, or to the left of, a cell is open; sizes are
    the rows and columns of each page. Each cell takes the least number among its neighbours and
    goes on with that cell's, until none changes."""
    pages, rows, cols = flat.shape
    least = np.broadcast_to(np.arange(rows * cols, dtype=np.int32).reshape(1, rows, cols), flat.shape).copy()
    r, c = np.arange(rows)[:, None], np.arange(cols)
    real = (r < sizes[:, 0, None, None]) & (c < sizes[:, 1, None, None])
    over, left = flat[:, 1:] & real[:, 1:], upright[:, :, 1:] & real[:, :, 1:]
    while True:
        before = least.copy()
        for open_, near, far in ((over, least[:, 1:], least[:, :-1]), (left, least[:, :, 1:], least[:, :, :-1])):
            np.minimum(near, far, out=near, where=open_)
            np.minimum(far, near, out=far, where=open_)
        flatter = least.reshape(pages, -1)
        flatter[:] = np.take_along_axis(flatter, flatter, 1)
        if np.array_equal(before, least):
            break
    page, row, col = np.nonzero(real)
    key = page * (rows * cols) + least[real]
    found, group, n = np.unique(key, return_inverse=True, return_counts=True)
    end_row, first_col, end_col = np.zeros(len(found), np.int64), np.full(len(found), cols), np.zeros(len(found), np.int64)
    np.maximum.at(end_row, group, row)
    np.minimum.at(first_col, group, col)
    np.maximum.at(end_col, group, col)
    root_row, root_col = found % (rows * cols) // cols, found % cols
    height, width = np.minimum(end_row - root_row + 1, max_span), np.minimum(end_col - first_col + 1, max_span)
    more = (height > 1) | (width > 1)
    return [found // (rows * cols), root_row, root_col, root_row, end_row, first_col, end_col, height, width, more, n, np.where(more, 0.75, 0.9)]


def _merge(listed: DataFrame, on: str, max_span: int, known: bool) -> DataFrame:
    """Merges the cells of pages: n_rows, n_cols, and for both orientations lists _h and _v of edges,
    row << 32 | col: the open ones, or if `known`, those that are not."""
    schema = f"{on} {dict(listed.dtypes)[on]}, {_MERGED}"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("n_rows", "n_cols")], 1)
            at = 0
            while at < len(sizes):
                most = np.cumprod(np.maximum.accumulate(sizes[at:]), axis=1)[:, 1] * np.arange(1, len(sizes) - at + 1)
                n = max(1, int(np.searchsorted(most, AT_ONCE, "right")))
                part, own = b.slice(at, n), sizes[at : at + n]
                at += n
                if not own.max(0).all():
                    part, own = part.filter(pa.array(own.all(1))), own[own.all(1)]
                    if not len(own):
                        continue
                rows, cols = own.max(0)
                sides = []
                for name in ("_h", "_v"):
                    lists = part.column(name)
                    ends = lists.offsets.to_numpy().astype(np.int64)
                    edges = lists.flatten().to_numpy(zero_copy_only=False)
                    page, row, col = np.repeat(np.arange(len(own)), np.diff(ends)), edges >> 32, edges & 0xFFFFFFFF
                    inside = (row < rows) & (col < cols)  # edges on the far rim part no two cells
                    side = np.full((len(own), rows, cols), known)
                    side[page[inside], row[inside], col[inside]] = not known
                    sides.append(side)
                out = _merged(*sides, own, max_span)
                kinds = [part.column(on).type, *[pa.int32()] * 8, pa.bool_(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(on).take(pa.array(out[0])), *[pa.array(x).cast(k) for x, k in zip(out[1:], kinds[1:], strict=True)]], names=[on, *[x.split()[0] for x in _MERGED.split(", ")]])

    return listed.select(on, "n_rows", "n_cols", "_h", "_v").mapInArrow(merge, schema)


def merged_cells(edges: DataFrame, on: str = "page", max_span: int = 6) -> DataFrame:
    """Cells of each page's grid, merged where the edge between them is inferred. Pages are
    taken some at a time."""
    flat, open_ = F.col("orientation") == "horizontal", F.col("is_inferred")
    edge = F.shiftleft(F.col("row").cast("long"), 32).bitwiseOR(F.col("col"))
    listed = edges.groupBy(on).agg(
        F.coalesce(F.max(F.when(flat, F.col("row"))), F.lit(0)).alias("n_rows"), F.coalesce(F.max(F.when(~flat, F.col("col"))), F.lit(0)).alias("n_cols"),
        F.collect_list(F.when(flat & open_, edge)).alias("_h"), F.collect_list(F.when(~flat & open_, edge)).alias("_v"),
    )
    return _merge(listed, on, max_span, False)


def merged_grid_cells(lines: DataFrame, on: str = "page", max_span: int = 6, tolerance: float = SNAP) -> DataFrame:
    """merged_cells of grid_edges, without a row for each edge: of the edges that few lines cover."""
    code = lambda row, col: F.shiftleft(row.cast("long"), 32).bitwiseOR(col)
    grid = _grid_lines(lines, [on], tolerance)
    horizontal = F.flatten(F.transform("h", lambda line, i: F.transform(line["steps"], lambda j: code(i, j))))
    vertical = F.flatten(F.transform("v", lambda line, i: F.transform(line["steps"], lambda j: code(j, i))))
    return _merge(grid.select(on, (F.size("h") - 1).alias("n_rows"), (F.size("v") - 1).alias("n_cols"), horizontal.alias("_h"), vertical.alias("_v")), on, max_span, True)


def score_gaps(gaps: DataFrame) -> DataFrame:
    """Adds the alignment score of each gap: 0.35 for a crossing axis near its start,
    0.35 near its end, 0.15 for one inside, 0.15 for a parallel axis 5 to 200 pixels away.
    The page's axes of both orientations are in the arrays _h and _v."""
    flat = F.col("orientation") == "horizontal"
    cross, same = F.when(flat, F.col("_v")).otherwise(F.col("_h")), F.when(flat, F.col("_h")).otherwise(F.col("_v"))
    near = lambda at: F.exists(cross, lambda a: F.abs(a - at) <= AXIS_NEAR)
    within = F.exists(cross, lambda a: (a > F.col("gap_start")) & (a < F.col("gap_stop")))
    beside = (F.size(same) >= 2) & F.exists(same, lambda a: (F.abs(a - F.col("leader")) > 5) & (F.abs(a - F.col("leader")) < 200))
    part = lambda cond, v: F.when(cond, v).otherwise(0)
    hundredths = part(near(F.col("gap_start")), 35) + part(near(F.col("gap_stop")), 35) + part(within, 15) + part(beside, 15)
    return gaps.withColumn("score", hundredths / 100.0).drop("_h", "_v")


def fill_gaps(lines: DataFrame, on: tuple[str, ...] = ("page",), most: float = MAX_GAP, least_score: float = MIN_SCORE) -> DataFrame:
    """An audit row per gap of each axis, with its score and whether it is filled. The axes of
    a page are listed once, and meet its gaps when these are found."""
    keys = list(on)
    own = lambda kind: F.sort_array(F.collect_set(F.when(F.col("orientation") == kind, F.col("leader"))))
    axes = leader_axes(lines, (*on, "orientation"))
    listed = axes.groupBy(*keys).agg(own("horizontal").alias("_h"), own("vertical").alias("_v"))
    gaps = score_gaps(line_gaps(axes, (*on, "orientation", "leader")).join(listed.hint("merge"), keys))
    large = F.col("gap") > most
    out = gaps.withColumn("score", F.when(large, 0.0).otherwise(F.col("score")))
    return out.withColumn("accepted", ~large & (F.col("score") >= least_score))


def filled_lines(lines: DataFrame, audit: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """The detected lines and one line for each filled gap, of its score but 0.75 at most."""
    new = audit.where("accepted").select(*on, F.concat_ws(":", F.lit("gap"), "orientation", F.col("leader").cast("string"), F.col("gap_start").cast("string")).alias("line_id"), "orientation", F.col("leader").alias("axis"), F.col("gap_start").alias("start"), F.col("gap_stop").alias("stop"), F.least(F.lit(0.75), F.col("score")).alias("confidence"))
    return lines.select(*new.columns).withColumn("inferred", F.lit(False)).unionByName(new.withColumn("inferred", F.lit(True)))


def box_rules(boxes: DataFrame) -> DataFrame:
    """Accepts checkbox candidates (w, h, extent, fill) by size, shape and fill. A shape
    scores as it fills its box; fills other than those of an outline take from it."""
    ratio = F.col("w") / F.col("h")
    ok = F.col("w").between(12, 165) & F.col("h").between(12, 165) & ratio.between(0.70, 1.43) & (F.col("extent") >= 0.55) & F.col("fill").between(0.04, 0.48)
    shape: Column = F.least(F.lit(1.0), F.col("extent") * 1.2)
    return boxes.where(ok).withColumn("confidence", F.least(F.lit(1.0), shape * (1 - F.abs(F.col("fill") - 0.18) * 2)))
