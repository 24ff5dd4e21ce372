"""Queries of alignment, fusion, clustering and structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import both
from .functions import geometry as g
from .functions.text import label, widget
from .operators import align, cluster, fuse, quality, structure, templates
from .queries_records import _WIDGET as WIDGET_SQL
from .views import PAGE_H, PAGE_W, lines, regions, tokens, with_views

_INTER = "CASE WHEN least(t.x2, r.x2) > greatest(t.x1, r.x1) AND least(t.y2, r.y2) > greatest(t.y1, r.y1) THEN (least(t.x2, r.x2) - greatest(t.x1, r.x1)) * (least(t.y2, r.y2) - greatest(t.y1, r.y1)) ELSE 0.0e0 END"
_ALIGN = f"""
pairs AS (SELECT t.page, t.token_id, r.region_id, {_INTER} AS common, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta, (r.x2 - r.x1) * (r.y2 - r.y1) AS ra,
                 sqrt(((t.x1 + t.x2) / 2 - (r.x1 + r.x2) / 2) * ((t.x1 + t.x2) / 2 - (r.x1 + r.x2) / 2) + ((t.y1 + t.y2) / 2 - (r.y1 + r.y2) / 2) * ((t.y1 + t.y2) / 2 - (r.y1 + r.y2) / 2)) AS d
          FROM tokens t JOIN regions r ON t.page = r.page AND t.x1 < r.x2 + 20 AND t.x2 > r.x1 - 20 AND t.y1 < r.y2 + 20 AND t.y2 > r.y1 - 20),
measured AS (SELECT *, round(common / (ta + ra - common), 4) AS iou, round(common / ta, 4) AS coverage, round(d, 2) AS distance FROM pairs),
alignments AS (SELECT page, token_id, region_id, common, iou, coverage, distance,
                      CASE WHEN coverage >= 0.85 THEN 'inside' WHEN common > 0 THEN 'crosses' ELSE 'touching' END AS cls,
                      CASE WHEN coverage >= 0.85 THEN coverage WHEN common > 0 THEN iou ELSE greatest(0.1e0, 1 - distance / 100) END AS score FROM measured)
"""
_BOX = "t.page = r.page AND t.x1 <= r.x2 + {h} AND t.x2 >= r.x1 - {h} AND t.y1 <= r.y2 + {h} AND t.y2 >= r.y1 - {h}"


@both(with_views(_ALIGN + "SELECT page, token_id, region_id, cls, round(score, 4) AS score, iou, coverage, distance FROM alignments", "tokens", "regions"))
def token_region_alignment(spark: SparkSession, sf: str) -> DataFrame:
    out = align.align(tokens(spark, sf), regions(spark, sf))
    return out.select("page", "token_id", "region_id", "cls", F.round("score", 4).alias("score"), "iou", "coverage", "distance")


@both(with_views(_ALIGN + """
SELECT page, region_id, count(*) AS n, count(*) FILTER (cls = 'inside') AS k, round(max(score), 4) AS best,
       cast(count(*) * (count(*) - 1) / 2 + count(*) FILTER (cls = 'inside') * (count(*) FILTER (cls = 'inside') - 1) / 2 AS bigint) AS conflicts,
       round(least(1.0e0, greatest(0.0e0, 0.8e0 * max(score) - least(0.4e0, 0.1e0 * (count(*) * (count(*) - 1) / 2 + count(*) FILTER (cls = 'inside') * (count(*) FILTER (cls = 'inside') - 1) / 2)))), 4) AS final
FROM alignments GROUP BY page, region_id""", "tokens", "regions"))
def fused_fields(spark: SparkSession, sf: str) -> DataFrame:
    out = fuse.resolve(fuse.consolidate(align.align(tokens(spark, sf), regions(spark, sf))))
    return out.select("page", "region_id", "n", "k", F.round("best", 4).alias("best"), "conflicts", F.round("final", 4).alias("final"))


@both(with_views("SELECT t.page, count(*) AS pairs FROM tokens t JOIN regions r ON " + _BOX.format(h=0) + " GROUP BY t.page", "tokens", "regions"))
def grid_join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return align.grid_join(tokens(spark, sf), regions(spark, sf), ["page"]).groupBy("page").agg(F.count(F.lit(1)).alias("pairs"))


def _walls(spark: SparkSession, sf: str) -> DataFrame:
    rules = lines(spark, sf).where("orientation = 'vertical' AND axis % 200 = 0")
    return rules.select("page", F.col("axis").alias("x1"), (F.col("axis") + 2).alias("x2")).distinct()


_SCORED = f"""
walls AS (SELECT DISTINCT page, axis AS w FROM lines WHERE orientation = 'vertical' AND axis % 200 = 0),
cand AS (SELECT t.page, t.token_id, r.region_id, {_INTER} AS common, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta, (r.x2 - r.x1) * (r.y2 - r.y1) AS ra,
                least((t.x1 + t.x2) / 2, (r.x1 + r.x2) / 2) AS lo, greatest((t.x1 + t.x2) / 2, (r.x1 + r.x2) / 2) AS hi, greatest(t.y1, r.y1) < least(t.y2, r.y2) AS level
         FROM tokens t JOIN regions r ON {_BOX.format(h=0)}),
scored AS (SELECT page, token_id, region_id, 0.7e0 * (common / ta) + 0.3e0 * (common / (ta + ra - common)) AS score FROM cand c
           WHERE NOT (level AND EXISTS (SELECT 1 FROM walls w WHERE w.page = c.page AND w.w > c.lo AND w.w < c.hi))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, token_id ORDER BY score DESC, region_id) AS n FROM scored) WHERE n = 1),
assigned AS (SELECT t.page, t.token_id, b.region_id, b.score, coalesce(b.score < 0.2, true) AS orphaned FROM tokens t LEFT JOIN best b USING (page, token_id))
"""


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf)
    return align.best_assignment(t, align.score_assignments(t, regions(spark, sf), _walls(spark, sf)))


@both(with_views(_SCORED + "SELECT page, token_id, region_id, round(score, 6) AS score, orphaned FROM assigned", "tokens", "regions", "lines"))
def best_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("page", "token_id", "region_id", F.round("score", 6).alias("score"), "orphaned")


@both(with_views(_SCORED + """
SELECT a.page, count(*) AS tokens, count(*) FILTER (orphaned) AS orphans, count(*) FILTER (a.region_id IS NOT NULL AND r.region_id IS NULL) AS unknown_regions,
       count(*) - count(DISTINCT token_id) AS repeated, count(*) FILTER (orphaned) <= 0.4 * count(*) AND count(*) FILTER (a.region_id IS NOT NULL AND r.region_id IS NULL) = 0 AND count(*) = count(DISTINCT token_id) AS consistent
FROM assigned a LEFT JOIN regions r ON a.page = r.page AND a.region_id = r.region_id GROUP BY a.page""", "tokens", "regions", "lines"))
def assignment_validation(spark: SparkSession, sf: str) -> DataFrame:
    return align.validate_assignments(_assigned(spark, sf), regions(spark, sf))


@both(with_views("near AS (SELECT t.page, t.token_id, r.region_id, sqrt(power(greatest(r.x1 - t.x2, t.x1 - r.x2, 0.0e0), 2) + power(greatest(r.y1 - t.y2, t.y1 - r.y2, 0.0e0), 2)) AS d FROM tokens t JOIN regions r ON " + _BOX.format(h=50) + """)
SELECT page, token_id, region_id, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, token_id ORDER BY d, region_id) AS n FROM near WHERE d < 50) WHERE n = 1""", "tokens", "regions"))
def nearest_region(spark: SparkSession, sf: str) -> DataFrame:
    return align.nearest_region(tokens(spark, sf), regions(spark, sf)).withColumn("distance", F.round("distance", 4))


@both(with_views("SELECT t.page, t.token_id AS point_id, min(r.region_id) AS region_id FROM tokens t JOIN regions r ON t.page = r.page AND t.x1 BETWEEN r.x1 AND r.x2 AND t.y1 BETWEEN r.y1 AND r.y2 GROUP BY ALL", "tokens", "regions"))
def point_hits(spark: SparkSession, sf: str) -> DataFrame:
    points = tokens(spark, sf).select("page", F.col("token_id").alias("point_id"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    return align.point_hits(points, regions(spark, sf))


_WIDE = "wide AS (SELECT cast(floor(page / 20.0e0) AS bigint) AS page, region_id, x1, y1, x2, y2 FROM regions)"


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).withColumn("page", F.floor(F.col("page") / 20.0))


@both(with_views(_WIDE + """, held AS (SELECT r.page, r.region_id, o.region_id AS parent_id, (o.x2 - o.x1) * (o.y2 - o.y1) AS a FROM wide r JOIN wide o ON r.page = o.page AND r.region_id <> o.region_id
 AND o.x1 <= r.x1 + 5 AND o.y1 <= r.y1 + 5 AND o.x2 >= r.x2 - 5 AND o.y2 >= r.y2 - 5 AND (o.x2 - o.x1) * (o.y2 - o.y1) > 1.2e0 * (r.x2 - r.x1) * (r.y2 - r.y1)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, region_id ORDER BY a DESC, parent_id) AS n FROM held) WHERE n = 1)
SELECT w.page, w.region_id, p.parent_id FROM wide w LEFT JOIN p USING (page, region_id)""", "regions"))
def region_containment(spark: SparkSession, sf: str) -> DataFrame:
    return align.containment(_wide(spark, sf))


@both(with_views(_WIDE + """SELECT DISTINCT i.page, i.region_id AS grid_id FROM wide i JOIN wide o ON i.page = o.page AND i.region_id <> o.region_id
 AND o.x1 <= i.x1 + 10 AND o.y1 <= i.y1 + 10 AND o.x2 >= i.x2 - 10 AND o.y2 >= i.y2 - 10 AND (i.x2 - i.x1) * (i.y2 - i.y1) < 0.85e0 * ((o.x2 - o.x1) * (o.y2 - o.y1))""", "regions"))
def nested_grids(spark: SparkSession, sf: str) -> DataFrame:
    grids = _wide(spark, sf).withColumnRenamed("region_id", "grid_id")
    return align.nested_grids(grids, grids)


_ROWS = "marked AS (SELECT *, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, token_id) > 9.1e0 AS brk FROM tokens), rowed AS (SELECT *, cast(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, token_id ROWS UNBOUNDED PRECEDING) AS integer) AS row FROM marked)"


@both(with_views(_ROWS + "SELECT page, row, count(*) AS n, min(x1) AS x1, max(x2) AS x2 FROM rowed GROUP BY page, row", "tokens"))
def row_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.row_clusters(tokens(spark, sf), 9.1).groupBy("page", "row").agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"))


@both(with_views("""marked AS (SELECT *, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER (PARTITION BY page ORDER BY (x1 + x2) / 2, token_id) > 11.0e0 AS brk FROM tokens),
numbered AS (SELECT *, cast(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY (x1 + x2) / 2, token_id ROWS UNBOUNDED PRECEDING) AS integer) AS c FROM marked)
SELECT page, token_id, max(c) OVER (PARTITION BY page) - c AS col FROM numbered""", "tokens"))
def col_clusters_rtl(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.col_clusters(tokens(spark, sf), 11.0, rtl=True).select("page", "token_id", "col")


def _robust(source: str, name: str) -> str:
    return f"""{name}_q AS (SELECT page, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n, median(v) AS plain FROM {source} GROUP BY page),
{name}_m AS (SELECT s.page, median(v) AS inn, count(v) AS lft FROM {source} s JOIN {name}_q q USING (page) WHERE v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) GROUP BY s.page),
{name} AS (SELECT q.page, CASE WHEN n >= 4 AND lft >= 2 THEN inn ELSE plain END AS v FROM {name}_q q LEFT JOIN {name}_m USING (page))"""


_GEOMETRY = f"""heights AS (SELECT page, y2 - y1 AS v FROM tokens WHERE y2 - y1 > 2), starts AS (SELECT DISTINCT page, round_even(x1 / 5, 0) * 5 AS x FROM tokens),
gaps AS (SELECT * FROM (SELECT page, lead(x) OVER (PARTITION BY page ORDER BY x) - x AS v FROM starts) WHERE v > 3), widths AS (SELECT page, x2 - x1 AS v FROM tokens),
{_robust("heights", "h")}, {_robust("gaps", "gp")}, {_robust("widths", "w")},
sized AS (SELECT page, count(*) AS n_boxes FROM tokens GROUP BY page), cols AS (SELECT page, count(*) AS n_starts FROM starts GROUP BY page),
shape AS (SELECT s.page, n_boxes, CASE WHEN n_boxes < 3 THEN 20.0e0 ELSE coalesce(h.v, 20.0e0) END AS row_height,
          CASE WHEN n_boxes < 3 THEN 30.0e0 WHEN n_starts > 1 THEN coalesce(gp.v, 30.0e0) ELSE w.v / 2 END AS col_gap
          FROM sized s JOIN cols USING (page) LEFT JOIN h USING (page) LEFT JOIN gp USING (page) LEFT JOIN w USING (page)),
geometry AS (SELECT page, n_boxes, row_height, col_gap, CASE WHEN n_boxes < 3 THEN 15.0e0 ELSE greatest(8.0e0, row_height * 0.65e0) END AS eps_y,
             CASE WHEN n_boxes < 3 THEN 20.0e0 ELSE greatest(10.0e0, col_gap * 0.55e0) END AS eps_x FROM shape)
"""


@both(with_views(_GEOMETRY + "SELECT page, n_boxes, row_height, col_gap, round(eps_y, 6) AS eps_y, round(eps_x, 6) AS eps_x FROM geometry", "tokens"))
def page_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.page_geometry(tokens(spark, sf)).withColumns({"eps_y": F.round("eps_y", 6), "eps_x": F.round("eps_x", 6)})


@both(with_views(_GEOMETRY + "SELECT page, substr(sha256(concat_ws(':', '1', cast(n_boxes AS varchar), '0', cast(cast(round(row_height) AS bigint) AS varchar), cast(cast(round(col_gap) AS bigint) AS varchar), 'en')), 1, 16) AS layout_hash FROM geometry", "tokens"))
def layout_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    geo = cluster.page_geometry(tokens(spark, sf))
    return geo.select("page", cluster.layout_hash(F.lit(1), F.col("n_boxes"), F.lit(0), F.col("row_height"), F.col("col_gap"), F.lit("en")).alias("layout_hash"))


_FRAG = r"regexp_matches(trim(text), '^([.\-)]?\s*\d+\s*[.\-)]?|[()\[\]/\\-]|م\d+|\d+م|م)$')"
_GHOST = r"(text = '' OR regexp_matches(text, '^[._\-\s/\\:]+$') OR regexp_matches(text, '^[\s()\[\]]{1,2}$') OR regexp_matches(text, '^[\s□☐☑✓✗]{3,}$') OR " + _FRAG.replace("trim(text)", "text") + ")"
_CELLS = _ROWS + f""", fr AS (SELECT *, {_FRAG} AS frag FROM rowed),
gp AS (SELECT *, x1 - lag(x2) OVER w AS gap, frag OR lag(frag) OVER w AS any_frag, lag(x2) OVER w IS NULL AS head FROM fr WINDOW w AS (PARTITION BY page, row ORDER BY x1, token_id)),
bl AS (SELECT *, cast(sum(CASE WHEN head OR gap <= 30.0e0 OR (any_frag AND gap < 75.0e0) THEN 0 ELSE 1 END) OVER (PARTITION BY page, row ORDER BY x1, token_id ROWS UNBOUNDED PRECEDING) AS integer) AS block FROM gp),
raw_cells AS (SELECT page, row, block AS col, trim(string_agg(text, ' ' ORDER BY y1, x1, token_id, text)) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(confidence), 6) AS confidence, count(*) AS n_tokens,
              CASE WHEN count(*) FILTER (source = 'native') > floor(count(*) / 2) THEN 'native' ELSE 'ocr' END AS source FROM bl GROUP BY page, row, block),
cells AS (SELECT * FROM raw_cells WHERE NOT {_GHOST})
"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = cluster.row_clusters(tokens(spark, sf), 9.1)
    return cluster.layout_cells(cluster.merge_fragments(rows, 30.0))


@both(with_views(_CELLS + "SELECT page, row, col, text, x1, y1, x2, y2, round(confidence, 4) AS confidence, n_tokens, source FROM cells", "tokens"))
def layout_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).withColumn("confidence", F.round("confidence", 4)).select("page", "row", "col", "text", "x1", "y1", "x2", "y2", "confidence", "n_tokens", "source")


@both(with_views(_CELLS + "SELECT page, count(*) AS n_fields, count(*) FILTER (confidence < 0.945) AS issues, count(*) FILTER (source = 'native') AS native_fields FROM cells GROUP BY page", "tokens"))
def page_field_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).groupBy("page").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("confidence") < 0.945).alias("issues"), F.count_if(F.col("source") == "native").alias("native_fields"))


_LABEL = "CASE WHEN widget = 'checkbox' THEN coalesce(nullif(trim(regexp_replace(own, '□|☐|☑|✓|✗|\\[\\s*\\]|\\(\\s*\\)', '', 'g')), ''), 'اختيار') ELSE own END"


@both(with_views(_CELLS + f""", c AS (SELECT page, row, col, CASE WHEN col % 3 = 0 THEN concat(text, ':') ELSE text END AS t FROM cells),
w AS (SELECT *, {WIDGET_SQL} AS widget, CASE WHEN trim(split_part(t, chr(10), 1)) = '' THEN substr(t, 1, 80) ELSE trim(split_part(t, chr(10), 1)) END AS own FROM c),
l AS (SELECT page, row, col, widget, {_LABEL} AS label FROM w),
m AS (SELECT *, rtrim(label) LIKE '%:' AS colon, lag(widget) OVER (PARTITION BY page, row ORDER BY col) IN ('text', 'number', 'date', 'checkbox') AND NOT rtrim(label) LIKE '%:' AND (widget = 'checkbox' OR widget = 'text' AND length(label) < 20) AS joins FROM l),
k AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY page, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS grp FROM m),
h AS (SELECT *, count(*) OVER (PARTITION BY page, row, grp) - 1 AS n, first_value(colon) OVER (PARTITION BY page, row, grp ORDER BY col) AS lead_colon FROM k),
z AS (SELECT *, n >= 2 OR n = 1 AND lead_colon AS chosen FROM h)
SELECT page, row, col, label, widget, 0 AS n_options, '' AS options FROM z WHERE NOT chosen
UNION ALL SELECT page, row, min(col), trim(replace(arg_min(label, col), ':', '')), 'select', cast(any_value(n) AS integer), string_agg(label, '|' ORDER BY col) FILTER (joins) FROM z WHERE chosen GROUP BY page, row, grp""", "tokens"))
def option_groups(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf).withColumn("text", F.when(F.col("col") % 3 == 0, F.concat("text", F.lit(":"))).otherwise(F.col("text")))
    kind = widget(F.col("text"))
    return cluster.group_options(cluster.cell_fields(cells, kind, label(F.col("text"), kind)))


@both(with_views("""marked AS (SELECT page, axis, line_id, axis - lag(axis) OVER (PARTITION BY page ORDER BY axis, line_id) > 8.0e0 AS brk FROM lines WHERE orientation = 'horizontal'),
grouped AS (SELECT page, axis, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY axis, line_id ROWS UNBOUNDED PRECEDING) AS grp FROM marked)
SELECT page, round(avg(axis), 6) AS position, count(*) AS n FROM grouped GROUP BY page, grp""", "lines"))
def snapped_positions(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.snap(lines(spark, sf).where("orientation = 'horizontal'"), ["page"], "axis", 8.0).withColumn("position", F.round("position", 6))


_LEADERS = """longs AS (SELECT * FROM lines WHERE stop - start >= 20),
folded AS (SELECT page, orientation, list_reduce(list_prepend([-1.0e9, -1.0e9], list_transform(list_sort(list_distinct(list(axis))), lambda a: [a, a])),
           lambda s, a: CASE WHEN a[1] - s[len(s)] <= 6 THEN list_concat(s, [a[1], s[len(s)]]) ELSE list_concat(s, [a[1], a[1]]) END) AS f FROM longs GROUP BY page, orientation),
axes AS (SELECT page, orientation, f[2 * i - 1] AS axis, f[2 * i] AS leader FROM (SELECT page, orientation, f, unnest(range(2, cast(len(f) / 2 + 1 AS bigint))) AS i FROM folded)),
frags AS (SELECT l.page, l.orientation, a.leader, l.start, l.stop FROM longs l JOIN axes a USING (page, orientation, axis)),
reach AS (SELECT *, max(stop) OVER (PARTITION BY page, orientation, leader ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM frags),
gaps AS (SELECT DISTINCT page, orientation, leader, gap_start, start AS gap_stop, start - gap_start AS gap FROM reach WHERE start > gap_start + 2)
"""


@both(with_views(_LEADERS + "SELECT page, orientation, leader, count(*) AS n, min(start) AS first, max(stop) AS last FROM frags GROUP BY ALL", "lines"))
def leader_axes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.leader_axes(lines(spark, sf)).groupBy("page", "orientation", "leader").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("stop").alias("last"))


@both(with_views(_LEADERS + "SELECT * FROM gaps", "lines"))
def line_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.line_gaps(cluster.leader_axes(lines(spark, sf)))


@both(with_views(_LEADERS + """, ax AS (SELECT DISTINCT page, orientation, leader FROM frags),
scored AS (SELECT g.*, CASE WHEN gap > 80 THEN 0 ELSE
  CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation <> g.orientation AND abs(a.leader - g.gap_start) <= 12) THEN 35 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation <> g.orientation AND abs(a.leader - g.gap_stop) <= 12) THEN 35 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation <> g.orientation AND a.leader > g.gap_start AND a.leader < g.gap_stop) THEN 15 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation = g.orientation AND abs(a.leader - g.leader) > 5 AND abs(a.leader - g.leader) < 200) THEN 15 ELSE 0 END END AS s FROM gaps g)
SELECT page, orientation, leader, gap_start, gap_stop, gap, s / 100.0e0 AS score, gap <= 80 AND s >= 55 AS accepted FROM scored""", "lines"))
def gap_audit(spark: SparkSession, sf: str) -> DataFrame:
    return structure.fill_gaps(lines(spark, sf))


@both(with_views("""marked AS (SELECT *, floor(y1 / 4) AS line FROM tokens),
gp AS (SELECT *, abs(y1 - lag(y1) OVER w) <= 4 AND (lag(x1) OVER w - x2 BETWEEN 0 AND 8 OR x1 - lag(x2) OVER w BETWEEN 0 AND 8) AS near, lag(x1) OVER w IS NULL AS head FROM marked WINDOW w AS (PARTITION BY page ORDER BY line, x2 DESC, token_id)),
ch AS (SELECT *, cast(sum(CASE WHEN head OR near THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line, x2 DESC, token_id ROWS UNBOUNDED PRECEDING) AS integer) AS chain FROM gp)
SELECT page, chain, string_agg(text, '' ORDER BY x1, token_id, text) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_tokens FROM ch GROUP BY page, chain""", "tokens"))
def token_chains(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.token_chains(tokens(spark, sf))


@both(with_views("""r AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, token_id ROWS UNBOUNDED PRECEDING) AS row FROM (SELECT *, CASE WHEN (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, token_id) > 15 THEN 1 ELSE 0 END AS b FROM tokens)),
c AS (SELECT page, token_id, row, confidence, x1, x2, text, sum(d) OVER (PARTITION BY page ORDER BY (x1 + x2) / 2, token_id ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER (PARTITION BY page ORDER BY (x1 + x2) / 2, token_id) > 40 THEN 1 ELSE 0 END AS d FROM r)),
size AS (SELECT page, cast(max(row) AS bigint) AS mr, cast(max(col) AS bigint) AS mc FROM c GROUP BY page),
dense AS (SELECT page, row, unnest(range(0, mc + 1)) AS col FROM (SELECT page, mc, unnest(range(0, mr + 1)) AS row FROM size))
SELECT d.page, cast(d.row AS integer) AS row, cast(d.col AS integer) AS col, coalesce(string_agg(text, ' ' ORDER BY (x1 + x2) / 2, token_id, text), '') AS text, coalesce(round(avg(confidence), 6), 0.0e0) AS confidence
FROM dense d LEFT JOIN c ON d.page = c.page AND d.row = c.row AND d.col = c.col GROUP BY ALL""", "tokens"))
def table_grid(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.table_grid(tokens(spark, sf))


@both(with_views(f"""long AS (SELECT page, min(axis) AS first, max(axis) AS last FROM lines WHERE orientation = 'horizontal' AND stop - start > 120 GROUP BY page)
SELECT page, 'header' AS region_type, 0.0e0 AS y1, first AS y2, 0.85e0 AS confidence FROM long WHERE first > 10 AND first < {PAGE_H} * 0.2e0
UNION ALL SELECT page, 'footer', last, cast({PAGE_H} AS double), 0.8e0 FROM long WHERE last > {PAGE_H} * 0.8e0""", "lines"))
def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    return structure.page_regions(lines(spark, sf), 300.0, PAGE_H)


@both(with_views("SELECT page, line_id, CASE WHEN stop - start >= 0.85e0 * 200 THEN 'section_boundary' ELSE 'horizontal_rule' END AS anchor_type FROM lines WHERE orientation = 'horizontal' AND stop - start >= 0.55e0 * 200", "lines"))
def section_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return structure.section_anchors(lines(spark, sf), 200.0).select("page", "line_id", "anchor_type")


@both(with_views(f"""h AS (SELECT page, axis, line_id, lead(axis) OVER w IS NULL AS last, axis - lag(axis) OVER w AS gap FROM lines WHERE orientation = 'horizontal' WINDOW w AS (PARTITION BY page ORDER BY axis, line_id)),
z AS (SELECT *, sum(CASE WHEN gap > {PAGE_H} * 0.12e0 AND NOT last THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY axis, line_id ROWS UNBOUNDED PRECEDING) AS zone FROM h),
gr AS (SELECT page, zone, min(axis) AS y1, max(axis) AS y2, count(*) AS n_h FROM z GROUP BY page, zone HAVING count(*) >= 2)
SELECT gr.page, greatest(0.0e0, min(v.axis) - 5) AS x1, y1, least({PAGE_W}, max(v.axis) + 5) AS x2, y2, n_h, count(*) AS n_v
FROM gr JOIN lines v ON v.page = gr.page AND v.orientation = 'vertical' AND NOT (v.stop < y1 OR v.start > y2) GROUP BY gr.page, zone, y1, y2, n_h HAVING count(*) >= 2""", "lines"))
def table_zones(spark: SparkSession, sf: str) -> DataFrame:
    return structure.table_zones(lines(spark, sf), PAGE_W, PAGE_H)


_EDGES = """m AS (SELECT page, orientation, axis, line_id, axis - lag(axis) OVER (PARTITION BY page, orientation ORDER BY axis, line_id) > 8 AS brk FROM lines),
gq AS (SELECT page, orientation, axis, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY page, orientation ORDER BY axis, line_id ROWS UNBOUNDED PRECEDING) AS grp FROM m),
pos0 AS (SELECT page, orientation, avg(axis) AS p FROM gq GROUP BY page, orientation, grp),
pos AS (SELECT page, orientation, p, row_number() OVER w - 1 AS k, lead(p) OVER w AS nxt FROM pos0 WINDOW w AS (PARTITION BY page, orientation ORDER BY p)),
ok AS (SELECT page FROM pos GROUP BY page HAVING count(*) FILTER (orientation = 'horizontal') >= 2 AND count(*) FILTER (orientation = 'vertical') >= 2),
spans AS (SELECT a.page, a.orientation, a.p AS axis, a.k AS line, b.p AS f, b.nxt AS t, b.k AS step FROM pos a JOIN pos b ON a.page = b.page AND a.orientation <> b.orientation AND b.nxt IS NOT NULL WHERE a.page IN (SELECT page FROM ok)),
edges AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM lines l WHERE l.page = s.page AND l.orientation = s.orientation AND abs(l.axis - s.axis) < 8 AND l.start <= s.f + 8 AND l.stop >= s.t - 8) AS is_inferred FROM spans s)
"""


@both(with_views(_EDGES + "SELECT page, orientation, cast(CASE WHEN orientation = 'horizontal' THEN line ELSE step END AS integer) AS row, cast(CASE WHEN orientation = 'horizontal' THEN step ELSE line END AS integer) AS col, round(axis, 6) AS axis, round(f, 6) AS \"from\", round(t, 6) AS \"to\", is_inferred FROM edges", "lines"))
def grid_edges(spark: SparkSession, sf: str) -> DataFrame:
    return structure.grid_edges(lines(spark, sf)).withColumns({c: F.round(c, 6) for c in ("axis", "from", "to")})


@both(with_views(_EDGES + "SELECT page, cast(max(line) FILTER (orientation = 'horizontal') AS integer) AS n_rows, cast(max(line) FILTER (orientation = 'vertical') AS integer) AS n_cols, count(*) FILTER (is_inferred) AS n_inferred, CASE WHEN count(*) FILTER (is_inferred) > 0 THEN 0.7e0 ELSE 0.9e0 END AS confidence FROM edges GROUP BY page", "lines"))
def page_grids(spark: SparkSession, sf: str) -> DataFrame:
    return structure.grids(structure.grid_edges(lines(spark, sf))).select("page", "n_rows", "n_cols", "n_inferred", "confidence")


@both("WITH RECURSIVE " + with_views(_EDGES, "lines").strip().removeprefix("WITH ").rstrip().rstrip(",") + """,
size AS (SELECT page, max(line) FILTER (orientation = 'horizontal') AS nr, max(line) FILTER (orientation = 'vertical') AS nc FROM edges GROUP BY page),
cells AS (SELECT page, r, unnest(range(0, nc)) AS c FROM (SELECT page, nc, unnest(range(0, nr)) AS r FROM size)),
opened AS (SELECT page, CASE WHEN orientation = 'horizontal' THEN line - 1 ELSE step END AS r, CASE WHEN orientation = 'horizontal' THEN step ELSE line - 1 END AS c, CASE WHEN orientation = 'horizontal' THEN line ELSE step END AS r2, CASE WHEN orientation = 'horizontal' THEN step ELSE line END AS c2
  FROM edges JOIN size USING (page) WHERE is_inferred AND line > 0 AND line < CASE WHEN orientation = 'horizontal' THEN nr ELSE nc END),
adj AS (SELECT page, r * 10000 + c AS a, r2 * 10000 + c2 AS b FROM opened UNION ALL SELECT page, r2 * 10000 + c2, r * 10000 + c FROM opened),
lab(page, a, m) USING KEY (page, a) AS (SELECT page, r * 10000 + c, r * 10000 + c FROM cells
  UNION SELECT x.page, adj.b, min(x.m) FROM lab x JOIN adj ON adj.page = x.page AND adj.a = x.a JOIN recurring.lab y ON y.page = x.page AND y.a = adj.b AND y.m > x.m GROUP BY ALL),
g AS (SELECT page, m, min(a // 10000) AS row_start, max(a // 10000) AS row_end, min(a % 10000) AS col_start, max(a % 10000) AS col_end, count(*) AS n FROM lab GROUP BY page, m)
SELECT page, cast(m // 10000 AS integer) AS root_row, cast(m % 10000 AS integer) AS root_col, cast(row_start AS integer) AS row_start, cast(row_end AS integer) AS row_end, cast(col_start AS integer) AS col_start, cast(col_end AS integer) AS col_end,
 cast(least(row_end - row_start + 1, 6) AS integer) AS rowspan, cast(least(col_end - col_start + 1, 6) AS integer) AS colspan, row_end > row_start OR col_end > col_start AS is_merged, cast(n AS integer) AS n_cells, CASE WHEN row_end > row_start OR col_end > col_start THEN 0.75e0 ELSE 0.9e0 END AS confidence FROM g""")
def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    return structure.merged_grid_cells(lines(spark, sf))


_DENSITY = f"density AS (SELECT page, cast(greatest(least(floor((y1 + y2) / 2 / 100.0e0), 9), 0) * 10 + greatest(least(floor((x1 + x2) / 2 / 120.0e0), 9), 0) AS integer) AS cell, count(*) AS n FROM wide GROUP BY ALL)"


@both(with_views(_WIDE + ", " + _DENSITY + "SELECT page, cell, n FROM density", "regions"))
def region_density(spark: SparkSession, sf: str) -> DataFrame:
    return templates.density(_wide(spark, sf), PAGE_W, PAGE_H)


def _prints(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cells = templates.density(_wide(spark, sf), PAGE_W, PAGE_H)
    return cells, templates.fingerprints(cells, F.lit(1.0) + F.col("page") % 3)


_DRIFT = _WIDE + ", " + _DENSITY + """, sizes AS (SELECT page, sum(n) AS regions, 1.0e0 + page % 3 AS aspect FROM density GROUP BY page),
gap AS (SELECT a, b, sum(abs(coalesce(na, 0) - coalesce(nb, 0))) AS g FROM (SELECT p.a, p.b, d.cell, d.n AS na FROM pairs p JOIN density d ON d.page = p.a) FULL JOIN (SELECT p.a, p.b, d.cell, d.n AS nb FROM pairs p JOIN density d ON d.page = p.b) USING (a, b, cell) GROUP BY a, b),
drifts AS (SELECT gap.a, gap.b, 0.4e0 * abs(sa.regions - sb.regions) / greatest(sa.regions, sb.regions) + 0.1e0 * abs(sa.aspect - sb.aspect) / greatest(sa.aspect, sb.aspect) + 0.5e0 * least(1.0e0, g / (2 * greatest(sa.regions, sb.regions))) AS d
           FROM gap JOIN sizes sa ON sa.page = a JOIN sizes sb ON sb.page = b)
"""


@both(with_views(_DRIFT.replace(_DENSITY, _DENSITY + ", pairs AS (SELECT page AS a, page + 1 AS b FROM (SELECT DISTINCT page FROM density) x WHERE page + 1 IN (SELECT page FROM density))") + "SELECT a, b, round(d, 6) AS drift, CASE WHEN round(d, 6) < 0.05 THEN 'identical' WHEN round(d, 6) < 0.2 THEN 'minor_drift' WHEN round(d, 6) < 0.45 THEN 'moderate_drift' ELSE 'catastrophic_drift' END AS drift_class FROM drifts", "regions"))
def neighbour_drift(spark: SparkSession, sf: str) -> DataFrame:
    cells, prints = _prints(spark, sf)
    ids = prints.select(F.col("page").alias("a"))
    pairs = ids.join(prints.select(F.col("page").alias("b"), (F.col("page") - 1).alias("a")), "a").select("a", "b")
    return templates.pair_drift(pairs, cells, prints.select("page", "regions", "aspect"))


@both(with_views(_DRIFT.replace(_DENSITY, _DENSITY + ", pairs AS (SELECT x.page AS a, y.page AS b FROM (SELECT DISTINCT page FROM density) x, (SELECT DISTINCT page FROM density WHERE page % 7 = 0) y)") + "SELECT id, template_id, drift FROM (SELECT a AS id, b AS template_id, round(d, 6) AS drift, row_number() OVER (PARTITION BY a ORDER BY round(d, 6), b) AS n FROM drifts) WHERE n = 1 AND drift <= 0.7", "regions"))
def best_templates(spark: SparkSession, sf: str) -> DataFrame:
    prints = _prints(spark, sf)[1].withColumnRenamed("page", "id")
    return templates.best_templates(prints, prints.where("id % 7 = 0"), most=0.7)


@both("""WITH cells AS (SELECT l_orderkey AS doc, l_suppkey AS block, l_linenumber AS row, 1.0e0 - l_discount AS c FROM lineitem),
r AS (SELECT doc, block, row, avg(c) AS m FROM cells GROUP BY ALL), b AS (SELECT doc, block, avg(m) AS m FROM r GROUP BY ALL)
SELECT doc, round(avg(m), 6) AS mean FROM b GROUP BY doc""")
def mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("block"), F.col("l_linenumber").alias("row"), (1 - F.col("l_discount")).alias("confidence"))
    return quality.mean_of_means(cells, ["doc", "block", "row"]).withColumn("mean", F.round("mean", 6))


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    empty, boxed = F.col("l_linenumber") % 2 == 0, F.col("l_quantity") > 10
    per = items.groupBy(F.col("l_orderkey").alias("doc")).agg(
        F.round(F.avg(1 - F.col("l_tax") * 6), 6).alias("avg_confidence"), F.countDistinct(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))).alias("n_blocks"), F.count(F.lit(1)).alias("n_cells"),
        F.count_if(empty).alias("n_empty_cells"), F.count_if(boxed).alias("n_boxed_cells"), F.count_if((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 5)).alias("n_empty_blocks"),
    )
    return per.withColumns({"file_type": F.when(F.col("doc") % 2 == 0, "pdf").otherwise("docx")})


_GATE = """per AS (SELECT l_orderkey AS doc, round(avg(1 - l_tax * 6), 6) AS c, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS e, count(*) FILTER (l_quantity > 10) AS b, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_suppkey END) AS blocks, count(*) FILTER (l_linenumber = 1 AND l_quantity < 5) AS empty_blocks FROM lineitem GROUP BY l_orderkey),
v AS (SELECT doc, c, CASE WHEN c < 0.6 THEN 1 ELSE 0 END + CASE WHEN blocks = 0 THEN 1 ELSE 0 END + empty_blocks + CASE WHEN doc % 2 = 0 AND b = 0 THEN 1 ELSE 0 END + CASE WHEN e > 0.5 * n THEN 1 ELSE 0 END AS k FROM per)"""


@both(f"WITH {_GATE} SELECT doc, c AS avg_confidence, cast(k AS integer) AS n_violations, CASE WHEN k = 0 THEN 'pass' WHEN k = 1 AND c >= 0.6e0 * 0.8e0 THEN 'warning' ELSE 'hard_stop' END AS status FROM v")
def quarantine_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quarantine(_gate(spark, sf)).select("doc", "avg_confidence", "n_violations", "status")


@both(f"WITH {_GATE} SELECT CASE WHEN c >= 0.9 THEN 'AUTO_PASS' WHEN c >= 0.7 THEN 'QA_REVIEW' ELSE 'QUARANTINE' END AS outcome, count(*) AS n FROM per GROUP BY 1")
def governance(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf).groupBy(quality.governance(F.col("avg_confidence")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@both(with_views("odd AS (SELECT page, token_id, x1, y1, CASE WHEN x1 >= 800 THEN x1 ELSE x2 END AS x2, y2, confidence + CASE WHEN y1 >= 900 THEN 1 ELSE 0 END AS confidence FROM tokens) SELECT page, token_id, concat_ws(';', CASE WHEN NOT x2 > x1 THEN 'x2 must exceed x1' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence must be in [0, 1]' END) AS why FROM odd WHERE NOT x2 > x1 OR NOT confidence BETWEEN 0 AND 1", "tokens"))
def rejected_tokens(spark: SparkSession, sf: str) -> DataFrame:
    odd = tokens(spark, sf).withColumns({"x2": F.when(F.col("x1") >= 800, F.col("x1")).otherwise(F.col("x2")), "confidence": F.col("confidence") + (F.col("y1") >= 900).cast("int")})
    bad = quality.split_valid(odd, quality.box_rules())[1]
    return bad.select("page", "token_id", F.array_join("violations", ";").alias("why"))


@both(with_views("SELECT page, region_id, round(x1 / 1200, 6) AS nx1, round(y1 / 1000, 6) AS ny1, round(x2 / 1200, 6) AS nx2, round(y2 / 1000, 6) AS ny2, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x1 * 1.5e0 + 10 AS px1 FROM regions", "regions"))
def box_projections(spark: SparkSession, sf: str) -> DataFrame:
    b = g.box()
    n = g.normalized(b, F.lit("page_pixels"), F.lit(PAGE_W), F.lit(PAGE_H))
    return regions(spark, sf).select("page", "region_id", *[F.round(c, 6).alias(f"n{k}") for c, k in zip(n, ("x1", "y1", "x2", "y2"), strict=True)], g.area(b).alias("area"), g.x_center(b).alias("cx"), g.y_center(b).alias("cy"), g.project(b[0], F.lit(1.5), F.lit(10.0)).alias("px1"))
