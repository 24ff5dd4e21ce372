"""Queries of sources, traces, registries, plans and forms over tables that are made from the driver's, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import both
from .functions import geometry as g
from .functions import harvest
from .functions import text as tx
from .operators import align, analytics, cluster, fuse, quality, render, state, structure
from .plans import stages
from .queries_layout import _ALIGN, _CELLS, _GEOMETRY, _LEADERS
from .sources import images, readers, tables
from .views import PAGE_H, PAGE_W, lines, regions, tokens, with_views


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks, for those from which Python makes much more than they hold: a
    small file is read by one task, and small partitions are joined after a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _pick(column: str, names: tuple[str, ...]) -> Column:
    """One of the names by a number."""
    return F.array(*[F.lit(n) for n in names])[(F.col(column) % len(names)).cast("int")]


def _pick_sql(column: str, names: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[{column} % {len(names)} + 1]"


# --- projections and traces ---------------------------------------------------------
_NAMES = (*tx.WIDGETS, "email", "phone", "Text")
_NAME_SQL = _pick_sql("event_id", _NAMES)


@both(f"SELECT event_id, CASE WHEN {_NAME_SQL} IN ({', '.join(repr(w) for w in tx.WIDGETS)}) THEN {_NAME_SQL} ELSE 'text' END AS widget FROM events")
def known_widgets(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", tx.known_widget(_pick("event_id", _NAMES)).alias("widget"))


@both(with_views(_GEOMETRY + "SELECT page, round(eps_x * CASE WHEN page % 2 = 0 THEN 2.4e0 ELSE 1.5e0 END, 6) AS threshold FROM geometry", "tokens"))
def merge_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    own = cluster.page_geometry(tokens(spark, sf))
    return own.select("page", F.round(cluster.merge_threshold(F.col("eps_x"), F.col("page") % 2 == 0), 6).alias("threshold"))


_SPACED = "(SELECT *, CASE WHEN region_id % 3 = 0 THEN 'normalized' ELSE 'page_pixels' END AS space FROM (SELECT page, region_id, CASE WHEN region_id % 3 = 0 THEN x1 / 1000 ELSE x1 END AS x1, CASE WHEN region_id % 3 = 0 THEN y1 / 1000 ELSE y1 END AS y1, CASE WHEN region_id % 3 = 0 THEN x2 / 1000 ELSE x2 END AS x2, CASE WHEN region_id % 3 = 0 THEN y2 / 1000 ELSE y2 END AS y2 FROM regions))"


def _spaced(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("region_id") % 3 == 0
    own = regions(spark, sf).withColumns({c: F.when(part, F.col(c) / 1000).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    return own.withColumn("space", F.when(part, "normalized").otherwise("page_pixels"))


@both(with_views("s AS " + _SPACED + " SELECT region_id, " + ", ".join(f"round(CASE WHEN space = 'normalized' THEN {c} ELSE {c} / {s} END, 9) AS n{c}, round(CASE WHEN space = 'normalized' THEN {c} * {s} ELSE {c} END, 6) AS p{c}" for c, s in zip(("x1", "y1", "x2", "y2"), (PAGE_W, PAGE_H) * 2)) + " FROM s", "regions"))
def box_conversions(spark: SparkSession, sf: str) -> DataFrame:
    own, size = _spaced(spark, sf), (F.lit(PAGE_W), F.lit(PAGE_H))
    parts, dots = g.normalized(g.box(), F.col("space"), *size), g.pixels(g.box(), F.col("space"), *size)
    return own.select("region_id", *[c for n, a, b in zip(("x1", "y1", "x2", "y2"), parts, dots, strict=True) for c in (F.round(a, 9).alias(f"n{n}"), F.round(b, 6).alias(f"p{n}"))])


_DPI = "CASE WHEN p_partkey % 2 = 0 THEN 150 ELSE 96 END"


@both(f"""SELECT p_partkey, concat('normalized_opencv_300dpi', CASE WHEN p_partkey % 3 = 0 THEN '_cropped' WHEN p_partkey % 3 = 1 THEN '_cropped_deskewed' ELSE '' END) AS target_space,
round(300.0e0 / {_DPI}, 9) AS scale_x, CASE WHEN p_partkey % 3 < 2 THEN p_size * 1.0e0 ELSE 0.0e0 END AS offset_x, CASE WHEN p_partkey % 3 = 1 THEN p_size / 10.0e0 ELSE 0.0e0 END AS rotation,
CASE WHEN p_partkey % 3 < 2 THEN 300 ELSE {_DPI} END AS dpi_before, 300 AS dpi_after, round(100 * (300.0e0 / {_DPI}) + CASE WHEN p_partkey % 3 < 2 THEN p_size * 1.0e0 ELSE 0.0e0 END, 6) AS x_there, 100.0e0 AS x_back,
'page_pixels' AS identity_space, p_size * 1.0e0 AS same FROM part""")
def coordinate_traces(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    p = _t(spark, sf, "part").withColumn("dpi", g.dpi_trace(F.when(k % 2 == 0, 150).otherwise(96)))
    p = p.withColumn("crop", g.crop_trace(F.col("dpi"), size, F.lit(0.0))).withColumn("deskew", g.deskew_trace(F.col("crop"), size / 10))
    p = p.withColumn("t", F.when(k % 3 == 0, F.col("crop")).when(k % 3 == 1, F.col("deskew")).otherwise(F.col("dpi"))).withColumn("i", g.identity_trace(F.lit("page_pixels")))
    there = g.traced([F.lit(100.0)] * 4, F.col("t"))[0]
    return p.select("p_partkey", "t.target_space", F.round("t.scale_x", 9).alias("scale_x"), "t.offset_x", "t.rotation", "t.dpi_before", "t.dpi_after", F.round(there, 6).alias("x_there"), F.round(g.traced([there] * 4, F.col("t"), back=True)[0], 6).alias("x_back"), F.col("i.target_space").alias("identity_space"), g.traced([size] * 4, F.col("i"))[0].alias("same"))


@both(with_views("s AS " + _SPACED + f""", n AS (SELECT page, region_id, {", ".join(f"CASE WHEN space = 'normalized' THEN {c} ELSE {c} / {s} END AS {c}" for c, s in zip(("x1", "y1", "x2", "y2"), (PAGE_W, PAGE_H) * 2))} FROM s)
SELECT page, count(*) AS n, round(min(x1), 9) AS x1, round(max(y2), 9) AS y2, 'normalized' AS space FROM n GROUP BY page""", "regions"))
def layout_proposals(spark: SparkSession, sf: str) -> DataFrame:
    own = _spaced(spark, sf).groupBy("page").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "space")).alias("table_regions"))
    out = own.withColumn("r", g.normalized_regions(F.col("table_regions"), F.lit(PAGE_W), F.lit(PAGE_H)))
    return out.select("page", F.size("r").cast("long").alias("n"), F.round(F.array_min("r.x1"), 9).alias("x1"), F.round(F.array_max("r.y2"), 9).alias("y2"), F.array_max("r.space").alias("space"))


_SIDES = "CASE WHEN {k} % 5 = 0 THEN 'normalized' ELSE 'page_pixels' END AS space, CASE WHEN {k} % 7 = 0 THEN 900.0e0 ELSE 1200.0e0 END AS page_w, 1000.0e0 AS page_h"


def _sided(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumns({"space": F.when(key % 5 == 0, "normalized").otherwise("page_pixels"), "page_w": F.when(key % 7 == 0, 900.0).otherwise(1200.0), "page_h": F.lit(1000.0)})


@both(with_views(_ALIGN + f""", ts AS (SELECT page, token_id, any_value(source) AS source, {_SIDES.format(k="cast(split_part(token_id, '-', 2) AS bigint)")} FROM tokens GROUP BY ALL),
rs AS (SELECT page, region_id, {_SIDES.format(k="region_id")} FROM regions),
good AS (SELECT a.page, a.token_id, a.region_id, a.cls, round(a.score, 4) AS score, 0 AS n FROM alignments a JOIN ts t ON a.page = t.page AND a.token_id = t.token_id JOIN rs r ON a.page = r.page AND a.region_id = r.region_id WHERE t.space = 'page_pixels' AND r.space = 'page_pixels' AND t.page_w = r.page_w),
bad AS (SELECT t.page, t.token_id, r.region_id, 'crosses' AS cls, 0.0e0 AS score, CASE WHEN t.space <> 'page_pixels' THEN 1 ELSE 0 END + CASE WHEN r.space <> 'page_pixels' THEN 1 ELSE 0 END + CASE WHEN t.page_w <> r.page_w THEN 1 ELSE 0 END AS n FROM ts t JOIN rs r ON t.page = r.page)
SELECT page, cls, n AS n_violations, count(*) AS pairs, round(sum(score), 2) AS score FROM (SELECT * FROM good UNION ALL SELECT * FROM bad WHERE n > 0) GROUP BY page, cls, n""".replace(", ts AS (SELECT page, token_id, any_value(source) AS source,", ", ts AS (SELECT page, token_id,").replace("FROM tokens GROUP BY ALL)", "FROM tokens)"), "tokens", "regions"))
def coordinate_firewall(spark: SparkSession, sf: str) -> DataFrame:
    t = _sided(tokens(spark, sf), F.split_part("token_id", F.lit("-"), F.lit(2)).cast("long"))
    out = align.checked_align(t, _sided(regions(spark, sf), F.col("region_id")))
    return out.withColumn("score", F.round("score", 4)).groupBy("page", "cls", F.size("violations").alias("n_violations")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.col("score").cast("decimal(10,4)")), 2).cast("double").alias("score"))


@both(with_views("""p AS (SELECT a.page, a.region_id AS a, b.region_id AS b, greatest(0.0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS common, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba FROM regions a JOIN regions b ON a.page = b.page AND a.region_id < b.region_id)
SELECT a, b, a % 4 <> 0 AND b % 4 <> 0 AND common / (aa + ba - common) >= 0.25 OR a % 4 = 0 AND b % 4 = 0 AND common / (aa + ba - common) >= 0.25 AS overlaps, round(least(1.0e0, 0.35e0 * (common / aa) + 0.45e0 * (common / ba) + 0.2e0 * 0.5e0), 3) AS score FROM p""", "regions"))
def evidence_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    own = regions(spark, sf)
    other = own.select("page", F.col("region_id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = own.withColumnRenamed("region_id", "a").join(other, "page").where("a < b")
    space = lambda c: F.when(F.col(c) % 4 == 0, "normalized").otherwise("page_pixels")
    score = g.evidence_score(g.coverage(g.box(), g.box("r_")), g.coverage(g.box("r_"), g.box()), F.lit(0.5))
    return pairs.select("a", "b", g.overlaps(g.box(), g.box("r_"), space("a"), space("b")).alias("overlaps"), F.round(score, 3).alias("score"))


@both("SELECT p_partkey, concat('#', lpad(lower(hex(p_partkey % 256)), 2, '0'), lpad(lower(hex(p_size)), 2, '0'), lpad(lower(hex(p_partkey % 7)), 2, '0')) AS color FROM part")
def hex_colors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", g.hex_color(F.col("p_partkey") % 7, F.col("p_size"), F.col("p_partkey") % 256).alias("color"))


# --- hypotheses ---------------------------------------------------------------------
_FIGURES = "p_size / 50.0e0 AS f, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS near"
_PRIOR = {
    "checkbox": ("checkbox", "f", "0.0e0", "0.5e0", "'checkbox'"),
    "table_cell": ("table_cell", "f", "0.0e0", "f", "'text'"),
    "text_block": ("text_block", "0.3e0", "f", "0.0e0", "'text'"),
    "section_header": ("section_header", "0.8e0", "CASE WHEN near <> '' THEN 0.6e0 ELSE 0.0e0 END", "0.85e0", "'text'"),
    "radio_group": ("radio_group", "least(0.95e0, f * 1.1e0)", "CASE WHEN near <> '' THEN 0.5e0 ELSE 0.0e0 END", "0.65e0", "'radio'"),
    "merged_cell": ("table_cell", "f", "0.0e0", "0.8e0", "concat('span_', p_size % 4, 'r_', p_partkey % 3, 'c')"),
    "signature": ("signature_area", "greatest(0.5e0, 1 - f * 2.5e0)", "CASE WHEN near <> '' THEN 0.3e0 ELSE 0.0e0 END", "0.55e0", "'signature'"),
}
_HYPOTHESES = f"h0 AS (SELECT p_partkey, p_size, {_FIGURES} FROM part), h AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, '{t}' AS hypothesis_type, {a} AS gs, {b} AS ts, {c} AS ss, {d} AS hint FROM h0 WHERE p_partkey % 7 = {i}" for i, (k, (t, a, b, c, d)) in enumerate(_PRIOR.items())) + ")"


def _hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("p_size") / 50
    own = _t(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("near_text"), *[f.alias(c) for c in ("geometry_score", "structural_score", "text_confidence", "alignment", "confidence", "fill")],
        (F.col("p_size") % 4).alias("rowspan"), (F.col("p_partkey") % 3).alias("colspan"),
    )
    made = [analytics.hypotheses(own.where(F.col("p_partkey") % 7 == i), k).withColumn("kind", F.lit(k)) for i, k in enumerate(_PRIOR)]
    shown = ("p_partkey", "kind", "hypothesis_type", "geometry_score", "text_score", "structural_score", "fusion_score", "widget_hint", "accepted")
    out = made[0].select(*shown)
    for m in made[1:]:
        out = out.unionByName(m.select(*shown))
    return out


@both(f"WITH {_HYPOTHESES} SELECT p_partkey, kind, hypothesis_type, round(gs, 6) AS geometry_score, round(ts, 6) AS text_score, round(ss, 6) AS structural_score, cast(floor(least(1.0e0, 0.35e0 * gs + 0.45e0 * ts + 0.2e0 * ss) * 1000 + 0.25e0) AS bigint) AS fusion_score, hint AS widget_hint FROM h")
def hypothesis_priors(spark: SparkSession, sf: str) -> DataFrame:
    out = _hypotheses(spark, sf)
    return out.select("p_partkey", "kind", "hypothesis_type", *[F.round(c, 6).alias(c) for c in ("geometry_score", "text_score", "structural_score")], F.floor(F.col("fusion_score") * 1000 + 0.25).alias("fusion_score"), "widget_hint")


_SUBMITTED = """sub AS (SELECT event_id, user_id % 5 AS page, concat('h', event_id % 700) AS hypothesis_id, event_type AS hypothesis_type FROM events),
last AS (SELECT hypothesis_id, arg_max(hypothesis_type, event_id) AS hypothesis_type FROM sub GROUP BY 1),
dec AS (SELECT hypothesis_id, arg_max(ok, event_id) AS ok FROM (SELECT event_id, concat('h', event_id % 350) AS hypothesis_id, value > 40 AS ok FROM events WHERE user_id % 2 = 0) GROUP BY 1),
reg AS (SELECT s.page, s.hypothesis_id, row_number() OVER (PARTITION BY s.page ORDER BY event_id) AS place, l.hypothesis_type, coalesce(d.ok, false) AS accepted FROM sub s JOIN last l USING (hypothesis_id) LEFT JOIN dec d USING (hypothesis_id))"""


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    sub = e.select("event_id", (F.col("user_id") % 5).alias("page"), F.concat(F.lit("h"), (F.col("event_id") % 700).cast("string")).alias("hypothesis_id"), F.col("event_type").alias("hypothesis_type"))
    said = e.where("user_id % 2 = 0").select(F.concat(F.lit("h"), (F.col("event_id") % 350).cast("string")).alias("hypothesis_id"), (F.col("value") > 40).alias("accepted"), F.col("event_id").alias("seq"))
    return analytics.registry(sub, said, ["event_id"])


@both(f"WITH {_SUBMITTED} SELECT * FROM reg")
def hypothesis_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _registry(spark, sf).select("page", "hypothesis_id", "place", "hypothesis_type", "accepted")


@both(f"WITH {_SUBMITTED} SELECT hypothesis_id, place FROM reg WHERE hypothesis_type = 'view' AND page = 1 AND accepted")
def hypotheses_of_type(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.of_type(_registry(spark, sf), "view", 1, True).select("hypothesis_id", "place")


# --- sources ------------------------------------------------------------------------
_PAGE_JSON = """concat('{"ocr": {"source_engine": "ocr", "page_number": ', page, ', "tokens": [', {list}, ']}}')"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON text per page, with its tokens, lines and boxes."""
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    t = tokens(spark, sf).groupBy("page").agg(F.collect_list(F.struct(box, "text", "confidence")).alias("tokens"))
    at, flat = F.col("axis"), F.col("orientation") == "horizontal"
    ends = F.array(F.when(flat, F.col("start")).otherwise(at), F.when(flat, at).otherwise(F.col("start")), F.when(flat, F.col("stop")).otherwise(at), F.when(flat, at).otherwise(F.col("stop")))
    ln = lines(spark, sf).groupBy("page").agg(F.collect_list(F.struct(ends.alias("bbox"), "orientation", "confidence")).alias("lines"))
    r = regions(spark, sf).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("region_id", box))).alias("b")).select("page", F.transform("b", lambda x: F.struct(x["bbox"].alias("bbox"), F.lit(0.9).alias("confidence"))).alias("boxes"))
    own = t.join(ln, "page", "left").join(r, "page", "left")
    ocr = F.struct(F.lit("ocr").alias("source_engine"), F.col("page").cast("int").alias("page_number"), "tokens")
    return own.select(F.to_json(F.struct(ocr.alias("ocr"), F.struct("lines", "boxes").alias("geometry"))).alias("body"))


@both(with_views("SELECT page, sha256(concat_ws('|', page, x1, y1, text, 'ocr')) AS token_id, text, x1, y1, x2, y2, round(confidence, 6) AS confidence FROM tokens", "tokens"))
def evidence_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    out = readers.evidence_tokens(readers.parse_evidence(_evidence(spark, sf), "body"))
    return out.select("page", "token_id", "text", "x1", "y1", "x2", "y2", F.round("confidence", 6).alias("confidence"))


@both(with_views("SELECT page, orientation, count(*) AS n, min(axis) AS first, max(axis) AS last, sum(stop - start) AS total, sum(CASE WHEN orientation = 'horizontal' THEN axis + 0.1e0 ELSE start END) IS NOT NULL AS padded FROM lines WHERE page IN (SELECT page FROM tokens) GROUP BY page, orientation", "lines", "tokens"))
def evidence_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = readers.evidence_lines(readers.parse_evidence(_evidence(spark, sf), "body"))
    wide = F.min((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return out.groupBy("page", "orientation").agg(F.count(F.lit(1)).alias("n"), F.min("axis").alias("first"), F.max("axis").alias("last"), F.sum(F.col("stop") - F.col("start")).alias("total"), wide.alias("padded"))


@both(with_views("SELECT page, row_number() OVER (PARTITION BY page ORDER BY region_id) - 1 AS region_id, sha256(concat('region', sha256(concat_ws('|', 'box', page, x1, y1, x2, y2)))) AS region_key, x1, y1, x2, y2 FROM regions WHERE page IN (SELECT page FROM tokens)", "regions", "tokens"))
def evidence_region_keys(spark: SparkSession, sf: str) -> DataFrame:
    return readers.evidence_regions(readers.parse_evidence(_evidence(spark, sf), "body")).select("page", "region_id", "region_key", "x1", "y1", "x2", "y2")


@both("SELECT l_orderkey AS img_idx, CASE WHEN l_orderkey % 5 > 0 THEN concat('t', l_linenumber) END AS text, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber * 10.0e0 END AS x1, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber * 10.0e0 + 7 END AS x2, CASE WHEN l_orderkey % 5 > 0 THEN 12.0e0 END AS y2, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber END AS l_linenumber FROM lineitem WHERE l_orderkey % 5 > 0 UNION ALL SELECT DISTINCT l_orderkey, NULL FROM lineitem WHERE l_orderkey % 5 = 0) GROUP BY ALL")
def layout_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_linenumber") * 10.0
    corner = lambda a, b: F.array(a, F.lit(b))
    text = F.struct(F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("text"), F.lit(0.9).alias("confidence"), F.array(corner(x, 2.0), corner(x + 7, 3.0), corner(x + 6, 12.0), corner(x + 1, 11.0)).alias("text_region"))
    own = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(text).alias("r"))
    full = F.col("l_orderkey") % 5 > 0
    body = own.select(F.to_json(F.struct(F.lit("text").alias("type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("bbox"), F.col("l_orderkey").alias("img_idx"), F.when(full, F.col("r")).otherwise(F.slice("r", 1, 0)).alias("res"))).alias("body"))
    return readers.parse_layout(body, "body").groupBy("img_idx", "text", "x1", "x2", "y2").agg(F.count(F.lit(1)).alias("n"))


_EXTS = ("pdf", "docx", "xlsx", "XLS", "doc", "txt", "png", "zip")
_EXT_SQL = _pick_sql("doc_id", _EXTS)
_ROUTE_SQL = "CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in readers.ROUTES.items()) + " END"


@both(f"SELECT doc_id, {_ROUTE_SQL} AS route, concat('form', doc_id) AS form_type, source AS device, lang AS department, CASE WHEN {_ROUTE_SQL} IS NULL THEN concat('no reader for ', lower(ext)) END AS error FROM (SELECT *, {_EXT_SQL} AS ext FROM documents) WHERE doc_id % 10 > 0")
def named_files(spark: SparkSession, sf: str) -> DataFrame:
    """Folders named processed hold a tenth of the files."""
    folder = F.when(F.col("doc_id") % 10 == 0, "Processed/").otherwise("")
    path = F.concat(F.lit("file:/data/"), folder, "lang", F.lit("/"), "source", F.lit("/form"), F.col("doc_id").cast("string"), F.lit("."), _pick("doc_id", _EXTS))
    return readers.named_files(_t(spark, sf, "documents").select("doc_id", path.alias("path"))).select("doc_id", "route", "form_type", "device", "department", "error")


_WORDS = "SELECT page, token_id, x1 / 2 AS x1, y1 / 4 AS y1, x2 / 2 + 20 AS x2, y2 / 4 AS y2, text FROM tokens"


@both(with_views(f"""w AS ({_WORDS}), ok AS (SELECT page FROM w GROUP BY page HAVING sum(length(text)) >= 200),
p AS (SELECT page, token_id, text, least(greatest(x1 * 2, 0), 1200.0e0) AS x1, least(greatest(y1 * 4, 0), 1000.0e0) AS y1, least(greatest(x2 * 2, 0), 1200.0e0) AS x2, least(greatest(y2 * 4, 0), 1000.0e0) AS y2 FROM w WHERE page IN (SELECT page FROM w GROUP BY page HAVING sum(length(text)) >= 20))
SELECT page, token_id, x1, y1, x2, y2, 1.0e0 AS confidence, 'native' AS source FROM p WHERE x2 > x1 AND y2 > y1""".replace("ok AS (SELECT page FROM w GROUP BY page HAVING sum(length(text)) >= 200),\n", ""), "tokens"))
def native_words(spark: SparkSession, sf: str) -> DataFrame:
    own = tokens(spark, sf).select("page", "token_id", (F.col("x1") / 2).alias("x1"), (F.col("y1") / 4).alias("y1"), (F.col("x2") / 2 + 20).alias("x2"), (F.col("y2") / 4).alias("y2"), "text")
    sized = own.withColumns({"pt_w": F.lit(600.0), "pt_h": F.lit(250.0), "page_w": F.lit(PAGE_W), "page_h": F.lit(PAGE_H)})
    return readers.native_words(sized, ("page",)).select("page", "token_id", "x1", "y1", "x2", "y2", "confidence", "source")


@both(with_views("SELECT page, token_id, x1, least(y1, 1000.0e0) AS y1, least(x2 + 4, 1200.0e0) AS x2, least(y2 + 1, 1000.0e0) AS y2, CASE WHEN source = 'native' THEN 0.5e0 ELSE round(confidence, 6) END AS confidence, 'ocr' AS source FROM tokens WHERE least(x2 + 4, 1200.0e0) > x1 AND least(y2 + 1, 1000.0e0) > least(y1, 1000.0e0)", "tokens"))
def recognised_words(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines that lean; those without a confidence get the default."""
    corner = lambda x, y: F.array(F.col(x[0]) + x[1], F.col(y[0]) + y[1])
    own = tokens(spark, sf).withColumn("polygon", F.array(corner(("x1", 0), ("y1", 0)), corner(("x2", 4), ("y1", 2)), corner(("x2", 2), ("y2", 1)), corner(("x1", 1), ("y2", 0))))
    own = own.withColumns({"confidence": F.when(F.col("source") == "native", F.lit(None).cast("double")).otherwise(F.col("confidence")), "page_w": F.lit(PAGE_W), "page_h": F.lit(PAGE_H)}).drop("x1", "y1", "x2", "y2", "source")
    return readers.recognised_words(own).select("page", "token_id", "x1", "y1", "x2", "y2", F.round("confidence", 6).alias("confidence"), "source")


@both(with_views("""n AS (SELECT page, sum(length(text)) AS c FROM tokens WHERE source = 'native' GROUP BY page)
SELECT t.page, t.source, count(*) AS n FROM tokens t LEFT JOIN n USING (page) WHERE t.source = CASE WHEN coalesce(c, 0) >= 20 THEN 'native' ELSE 'ocr' END GROUP BY t.page, t.source""", "tokens"))
def page_sources(spark: SparkSession, sf: str) -> DataFrame:
    own = tokens(spark, sf)
    out = readers.native_first(own.where("source = 'native'"), own.where("source = 'ocr'"), on=("page",))
    return out.groupBy("page", "source").agg(F.count(F.lit(1)).alias("n"))


@both("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
s AS (SELECT doc_id, trim(t) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS row FROM l WHERE trim(t) <> '') SELECT doc_id, cast(row AS integer) AS row, text, 0 AS col, 'mixed' AS block_type, 0.85e0 AS confidence FROM s""")
def raw_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    pages = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return readers.raw_lines(pages, _t(spark, sf, "labels"), ("doc_id",)).select("doc_id", "row", "text", "col", "block_type", "confidence")


@both("SELECT concat('d', doc_id) AS path, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS integer) AS row, text, 0.7e0 AS confidence, 'mixed' AS block_type FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' \t\r\x0b\x0c\x1c\x1d\x1e\x1f') AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE text <> ''".replace("\\t", "\t"))
def text_cells(spark: SparkSession, sf: str) -> DataFrame:
    files = _t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("text").alias("route"), F.encode("text", "UTF-8").alias("content"))
    return readers.read_office(files).select("path", "row", "text", "confidence", "block_type")


def _zipped(parts: dict[str, object]) -> bytes:
    import zipfile
    from io import BytesIO

    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _sheet(rows):
    """Workbooks of one sheet, from the XML of its rows."""
    return rows.map(lambda body: _zipped({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'}))


def _document(turns):
    """Documents of paragraphs, where a system turn is a heading, and a table of all roles."""
    def one(r) -> bytes:
        p = lambda t, head: f'<w:p>{"<w:pPr><w:pStyle w:val=%sHeading1%s/></w:pPr>" % (chr(34), chr(34)) if head else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
        rows = "".join(f"<w:tr><w:tc>{p(x['turn'], False)}</w:tc><w:tc>{p(x['role'], False)}</w:tc></w:tr>" for x in r)
        body = "".join(p(f"{x['role']} {x['turn']}", x["turn"] % 4 == 0) for x in r)
        return _zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>'})

    return turns.map(one)


@both("""WITH i AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY k) - 1 AS row, unnest([0, 1, 2]) AS cell, unnest([f, '', cast(cast(q AS bigint) AS varchar)]) AS text FROM i)
SELECT o, cast(row AS integer) AS row, cast(cell AS integer) AS cell, text, row = 0 AS is_header FROM c""")
def sheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks whose second column is left out: cells keep the places that their references say."""
    i = _spread(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_orderkey")
    i = i.groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").cast("long").cast("string").alias("q"))
    cell = lambda c, t: F.concat(F.lit(f'<c r="{c}'), "k", F.lit('" t="inlineStr"><is><t>'), F.coalesce(F.col(t), F.lit("None")), F.lit("</t></is></c>"))
    row = F.concat(F.lit('<row r="'), "k", F.lit('">'), cell("A", "f"), cell("C", "q"), F.lit("</row>"))
    books = i.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    files = books.select(F.col("l_orderkey").cast("string").alias("path"), F.lit("xlsx").alias("route"), F.pandas_udf(_sheet, "binary")("rows").alias("content"))
    return readers.with_headers(readers.read_office(files)).select(F.col("path").cast("long").alias("o"), "row", "cell", "text", "is_header")


@both("""WITH t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL),
h AS (SELECT *, turn % 4 = 0 AS head, max(CASE WHEN turn % 4 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS top FROM t),
f AS (SELECT h.conv_id, 'form' AS block_type, concat(x.role, ' ', x.turn) AS title, cast(row_number() OVER (PARTITION BY h.conv_id, h.top ORDER BY h.turn) - 1 AS integer) AS row, 0 AS cell, concat(h.role, ' ', h.turn) AS text FROM h LEFT JOIN t x ON x.conv_id = h.conv_id AND x.turn = h.top WHERE NOT h.head),
last AS (SELECT conv_id, arg_max(concat(role, ' ', turn), turn) AS title FROM h WHERE head GROUP BY 1),
b AS (SELECT t.conv_id, 'table' AS block_type, last.title, cast(row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) - 1 AS integer) AS row, t.turn, t.role FROM t LEFT JOIN last USING (conv_id))
SELECT conv_id, block_type, CASE WHEN title = ' ' THEN NULL ELSE title END AS title, row, cell, text, false AS is_header FROM f UNION ALL SELECT conv_id, block_type, title, row, 0, cast(turn AS varchar), row = 0 FROM b UNION ALL SELECT conv_id, block_type, title, row, 1, role, row = 0 FROM b""")
def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    books = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    files = books.select(F.col("conv_id").cast("string").alias("path"), F.lit("docx").alias("route"), F.pandas_udf(_document, "binary")("turns").alias("content"))
    return readers.with_headers(readers.read_office(files)).select(F.col("path").cast("long").alias("conv_id"), "block_type", "title", "row", "cell", "text", "is_header")


@both("SELECT o_orderkey, concat('uploads/', strftime(o_orderdate, '%Y/%m/%d'), '/', o_custkey, '_', regexp_replace(concat(o_orderpriority, ' (', o_orderkey, ').pdf'), '[^0-9A-Za-z._-]', '_', 'g')) AS object_key, sha256(o_orderpriority) AS checksum, cast(length(o_orderpriority) AS integer) AS n_bytes FROM orders")
def stored_objects(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumns({"name": F.concat("o_orderpriority", F.lit(" ("), F.col("o_orderkey").cast("string"), F.lit(").pdf")), "unique": F.col("o_custkey").cast("string")})
    return readers.stored_objects(o, "name", "o_orderdate", "unique", "o_orderpriority").select("o_orderkey", "object_key", "checksum", "n_bytes")


def _counting(texts: list[str]) -> list[list[float]]:
    """Stands for a model in embedded_texts."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@both("SELECT doc_id, cast(length(substr(text, 1, 2000)) AS float) AS a, cast(length(substr(text, 1, 2000)) - length(replace(substr(text, 1, 2000), 'e', '')) AS float) AS b FROM documents")
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The model reads the first 2000 characters: the operator's own bound."""
    out = readers.embed(_t(spark, sf, "documents").select("doc_id", "text"), "text", _counting)
    return out.select("doc_id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


@both("SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN '  ' ELSE o_orderpriority END, ''], lambda x: trim(x) <> ''), ' | ') AS chunk FROM orders")
def chunked_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array("o_orderstatus", F.when(F.col("o_custkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority")), F.lit(""))
    return _t(spark, sf, "orders").select("o_orderkey", readers.chunk_text(cells).alias("chunk"))


@both("SELECT user_id, event_id AS version, cast(json_extract(props, '$.k') AS bigint) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n = 1")
def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("version"), F.col("props").alias("data"))
    return tables.lookup(rows, ["user_id"], {"event_type": "click"}, "k BIGINT").select("user_id", "version", F.col("data.k").alias("k"))


@both("""WITH s AS (SELECT o_orderpriority AS department, concat('d', o_custkey % 5) AS device, list_sort(list_distinct(list(concat('f', o_orderkey % 4)))) AS f, list_sort(list_distinct(list(o_orderstatus))) AS s FROM orders GROUP BY 1, 2)
SELECT concat('{"department":"', department, '","devices":{', string_agg(concat('"', device, '":{"form_types":["', array_to_string(f, '","'), '"],"sources":["', array_to_string(s, '","'), '"]}'), ',' ORDER BY device), '}}') AS value FROM s GROUP BY department""")
def structure_json(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c, n, p: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    rows = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("department"), name("o_custkey", 5, "d").alias("device"), name("o_orderkey", 4, "f").alias("form_type"), F.col("o_orderstatus").alias("source"))
    return tables.structure_json(analytics.structure(rows))


# --- alignment, fusion and cells ----------------------------------------------------
@both("""WITH f AS (SELECT o_orderkey AS field_id, o_custkey % 100 AS doc, o_custkey // 100 AS row FROM orders),
c AS (SELECT * FROM (SELECT c_custkey % 100 AS doc, c_custkey // 100 AS row, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS note, row_number() OVER (PARTITION BY c_custkey % 100, c_custkey // 100 ORDER BY c_acctbal DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1),
j AS (SELECT f.*, c.note, c.doc IS NOT NULL AND row_number() OVER (PARTITION BY f.doc, f.row ORDER BY field_id) = 1 AS hit FROM f LEFT JOIN c ON f.doc = c.doc AND f.row = c.row)
SELECT field_id, CASE WHEN hit THEN nullif(note, '') END AS note, hit AS human_corrected FROM j""")
def correction_notes(spark: SparkSession, sf: str) -> DataFrame:
    f = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("field_id"), (F.col("o_custkey") % 100).alias("doc"), F.floor(F.col("o_custkey") / 100).alias("row"), F.col("o_orderstatus").alias("label"), F.lit("text").alias("widget"), F.lit(True).alias("needs_qa"))
    note = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    c = _t(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("doc"), F.floor(F.col("c_custkey") / 100).alias("row"), F.lit("").alias("label"), F.lit("").alias("widget"), note.alias("note"), F.col("c_acctbal").alias("v1"), F.col("c_custkey").alias("v2"))
    return state.apply_corrections(f, c, ["doc", "row"], ["v1", "v2"]).select("field_id", "note", "human_corrected")


@both(with_views(_ALIGN + "SELECT a.token_id, a.region_id, a.cls, t.text, t.x1 AS token_x1, t.y2 AS token_y2, r.x1 AS region_x1, r.y2 AS region_y2 FROM alignments a JOIN tokens t ON a.page = t.page AND a.token_id = t.token_id JOIN regions r ON a.page = r.page AND a.region_id = r.region_id", "tokens", "regions"))
def alignment_view(spark: SparkSession, sf: str) -> DataFrame:
    t, r = tokens(spark, sf), regions(spark, sf)
    return fuse.alignment_view(align.align(t, r), t, r).select("token_id", "region_id", "cls", "text", "token_x1", "token_y2", "region_x1", "region_y2")


@both(with_views("""t AS (SELECT page, token_id, min(text) AS text FROM tokens GROUP BY ALL), f AS (SELECT page, max(token_id) AS k FROM t GROUP BY page)
SELECT f.page AS field_id, t.text AS first_text FROM f JOIN t ON t.page = f.page AND t.token_id = f.k""", "tokens"))
def field_first_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Fields whose first named token doesn't exist."""
    t = tokens(spark, sf).groupBy("page", "token_id").agg(F.min("text").alias("text"))
    fields = t.groupBy("page").agg(F.max("token_id").alias("k")).select("page", F.col("page").alias("field_id"), F.array(F.concat("k", F.lit("-x")), "k").alias("token_ids"))
    return fuse.first_tokens(fields, t).select("field_id", "first_text")


@both(with_views(_CELLS + f"SELECT page, row, col, round(x1 / {PAGE_W}, 9) AS nx1, round(y1 / {PAGE_H}, 9) AS ny1, round(x2 / {PAGE_W}, 9) AS nx2, round(y2 / {PAGE_H}, 9) AS ny2, left(split_part(text, chr(10), 1), 200) AS label, confidence < 0.65 AS needs_qa FROM cells", "tokens"))
def cell_fields(spark: SparkSession, sf: str) -> DataFrame:
    own = cluster.layout_cells(cluster.merge_fragments(cluster.row_clusters(tokens(spark, sf), 9.1), 30.0))
    out = cluster.cell_fields(own, F.lit("text"), tx.label(F.col("text"), F.lit("text")), F.lit(PAGE_W), F.lit(PAGE_H))
    return out.select("page", "row", "col", *[F.round(c, 9).alias(c) for c in ("nx1", "ny1", "nx2", "ny2")], "label", "needs_qa")


@both(with_views(_ALIGN + ", e AS (SELECT a.page, a.region_id, a.token_id AS a, b.token_id AS b FROM alignments a JOIN alignments b ON a.page = b.page AND a.region_id = b.region_id AND a.token_id < b.token_id) SELECT page, region_id, a, b, 0.5e0 AS weight FROM e WHERE NOT (region_id % 2 = 0 AND EXISTS (SELECT 1 FROM alignments x WHERE x.page = e.page AND x.region_id = e.region_id AND x.token_id = e.a AND x.cls = 'inside'))", "tokens", "regions"))
def conflict_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges exist already from inside tokens of even regions."""
    own = align.align(tokens(spark, sf), regions(spark, sf))
    every = fuse.conflict_edges(own)
    inside = own.where("cls = 'inside' AND region_id % 2 = 0").select("page", "region_id", F.col("token_id").alias("a"))
    return fuse.conflict_edges(own, every.join(inside, ["page", "region_id", "a"], "left_semi")).select("page", "region_id", "a", "b", "weight")


@both("""SELECT l_partkey AS target, round(sum(CASE WHEN l_returnflag = 'N' THEN 0.1e0 * l_quantity ELSE 0 END), 6) AS support, round(sum(CASE WHEN l_returnflag = 'R' THEN 0.2e0 * l_quantity ELSE 0 END), 6) AS conflict,
cast(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS integer) AS human FROM lineitem GROUP BY 1""")
def edge_confidence(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "supports").when(F.col("l_returnflag") == "R", "conflicts").otherwise("human")
    e = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), kind.alias("edge_type"), F.col("l_quantity").alias("weight"))
    return fuse.edge_confidence(e).withColumns({"support": F.round("support", 6), "conflict": F.round("conflict", 6)})


@both(with_views("SELECT page, count(*) AS n, CASE WHEN count(*) FILTER (source = 'native') = count(*) THEN 'native' WHEN count(*) FILTER (source = 'native') = 0 THEN 'ocr' ELSE 'hybrid' END AS mode, round(avg(confidence), 6) AS avg_confidence FROM tokens GROUP BY page", "tokens"))
def extraction_modes(spark: SparkSession, sf: str) -> DataFrame:
    n, native = F.count(F.lit(1)), F.count_if(F.col("source") == "native")
    return tokens(spark, sf).groupBy("page").agg(n.alias("n"), quality.extraction_mode(native, n).alias("mode"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


_FOLDS = """ys AS (SELECT page, list(token_id ORDER BY (y1 + y2) / 2, token_id) AS ids, list((y1 + y2) / 2 ORDER BY (y1 + y2) / 2, token_id) AS c FROM tokens GROUP BY page),
yf AS (SELECT page, ids, list_reduce(list_prepend([0.0e0, 0.0e0, -1.0e0], list_transform(c, lambda x: [x])), lambda s, t: CASE WHEN s[len(s) - 1] > 0 AND abs(t[1] - s[len(s) - 2] / s[len(s) - 1]) <= 15
  THEN list_concat(s[1:len(s) - 3], [s[len(s)], s[len(s) - 2] + t[1], s[len(s) - 1] + 1, s[len(s)]]) ELSE list_concat(s[1:len(s) - 3], [s[len(s)] + 1, t[1], 1.0e0, s[len(s)] + 1]) END) AS f FROM ys),
rowed AS (SELECT page, ids[i] AS token_id, cast(f[i] AS integer) AS row FROM (SELECT page, ids, f, unnest(range(1, len(ids) + 1)) AS i FROM yf)),
xs AS (SELECT page, list_sort(list_distinct(list(round((x1 + x2) / 2, 1)))) AS c FROM tokens GROUP BY page),
xf AS (SELECT page, list_reduce(list_transform(c, lambda x: [x]), lambda s, t: CASE WHEN abs(t[1] - s[len(s)]) <= 40 THEN list_concat(s[1:len(s) - 1], [(s[len(s)] + t[1]) / 2]) ELSE list_concat(s, t) END) AS c FROM xs)
"""


@both(with_views(_FOLDS + "SELECT page, token_id, row FROM rowed", "tokens"))
def nearest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.nearest_rows(tokens(spark, sf))


@both(with_views(_FOLDS + """, g AS (SELECT t.*, r.row, x.c AS cs, list_transform(x.c, lambda v: abs(v - (t.x1 + t.x2) / 2)) AS d FROM tokens t JOIN rowed r USING (page, token_id) JOIN xf x USING (page)),
p AS (SELECT *, list_position(d, list_min(d)) - 1 AS col FROM g),
size AS (SELECT page, max(row) AS mr, max(len(cs)) AS n FROM p GROUP BY page), dense AS (SELECT page, row, unnest(range(0, n)) AS col FROM (SELECT page, n, unnest(range(0, mr + 1)) AS row FROM size))
SELECT d.page, cast(d.row AS integer) AS row, cast(d.col AS integer) AS col, coalesce(string_agg(text, ' ' ORDER BY (x1 + x2) / 2, token_id, text), '') AS text, coalesce(round(avg(confidence), 6), 0.0e0) AS confidence, coalesce(min(x1), 0.0e0) AS x1, coalesce(max(y2), 0.0e0) AS y2
FROM dense d LEFT JOIN p ON d.page = p.page AND d.row = p.row AND d.col = p.col GROUP BY ALL""", "tokens"))
def nearest_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.nearest_cells(tokens(spark, sf)).select("page", "row", "col", "text", "confidence", "x1", "y2")


@both(with_views("SELECT page, token_id, text, cast(row_number() OVER (PARTITION BY page ORDER BY y1, x1, token_id, text, x2) AS integer) AS place FROM tokens", "tokens"))
def ordered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.ordered_tokens(tokens(spark, sf)).select("page", "token_id", "text", "place")


@both(f"""WITH b AS (SELECT p_partkey, p_partkey % 90 * 10.0e0 AS x1, p_partkey % 90 * 10.0e0 + p_size * 9.0e0 AS x2, p_partkey % 50 * 20.0e0 AS y1, [ 'signature_box', 'input_box', 'checkbox' ][p_partkey % 3 + 1] AS box_type, p_size / 50.0e0 AS confidence FROM part)
SELECT p_partkey, 'signature_area' AS region_type, round(confidence * 0.9e0, 6) AS confidence FROM b WHERE box_type <> 'checkbox' AND y1 > {PAGE_H} * 0.7e0 AND x2 - x1 > {PAGE_W} * 0.2e0""")
def signature_areas(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    b = _t(spark, sf, "part").select("p_partkey", (k % 90 * 10.0).alias("x1"), (k % 90 * 10.0 + F.col("p_size") * 9.0).alias("x2"), (k % 50 * 20.0).alias("y1"), F.array(*[F.lit(n) for n in ("signature_box", "input_box", "checkbox")])[(k % 3).cast("int")].alias("box_type"), (F.col("p_size") / 50).alias("confidence"))
    return structure.signature_areas(b, PAGE_W, PAGE_H).select("p_partkey", "region_type", F.round("confidence", 6).alias("confidence"))


_BOXES = "b AS (SELECT p_partkey, p_size * 4.0e0 AS w, p_size * 4.0e0 * (0.6e0 + p_partkey % 10 / 10.0e0) AS h, 0.5e0 + p_partkey % 50 / 100.0e0 AS extent, p_partkey % 60 / 100.0e0 AS fill FROM part)"


@both(f"WITH {_BOXES} SELECT p_partkey, round(least(1.0e0, least(1.0e0, extent * 1.2e0) * (1 - abs(fill - 0.18e0) * 2)), 6) AS confidence FROM b WHERE w BETWEEN 12 AND 165 AND h BETWEEN 12 AND 165 AND w / h BETWEEN 0.7e0 AND 1.43e0 AND extent >= 0.55e0 AND fill BETWEEN 0.04e0 AND 0.48e0")
def checkbox_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, w = F.col("p_partkey"), F.col("p_size") * 4.0
    b = _t(spark, sf, "part").select("p_partkey", w.alias("w"), (w * (0.6 + k % 10 / 10.0)).alias("h"), (0.5 + k % 50 / 100.0).alias("extent"), (k % 60 / 100.0).alias("fill"))
    return structure.box_rules(b).select("p_partkey", F.round("confidence", 6).alias("confidence"))


_AUDIT = """, ax AS (SELECT DISTINCT page, orientation, leader FROM frags),
scored AS (SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation <> g.orientation AND abs(a.leader - g.gap_start) <= 12) THEN 35 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation <> g.orientation AND abs(a.leader - g.gap_stop) <= 12) THEN 35 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation <> g.orientation AND a.leader > g.gap_start AND a.leader < g.gap_stop) THEN 15 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM ax a WHERE a.page = g.page AND a.orientation = g.orientation AND abs(a.leader - g.leader) > 5 AND abs(a.leader - g.leader) < 200) THEN 15 ELSE 0 END AS s FROM gaps g WHERE gap <= 80)"""


@both(with_views(_LEADERS + _AUDIT + """
SELECT page, orientation, axis, start, stop, round(confidence, 6) AS confidence, false AS inferred, count(*) AS n FROM lines GROUP BY ALL
UNION ALL SELECT page, orientation, leader, gap_start, gap_stop, round(least(0.75e0, s / 100.0e0), 6), true, count(*) FROM scored WHERE s >= 55 GROUP BY ALL""", "lines"))
def filled_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = lines(spark, sf)
    out = structure.filled_lines(own, structure.fill_gaps(own))
    return out.groupBy("page", "orientation", "axis", "start", "stop", F.round("confidence", 6).alias("confidence"), "inferred").agg(F.count(F.lit(1)).alias("n"))


# --- texts --------------------------------------------------------------------------
_ARABIC = "CASE event_id % 4 WHEN 0 THEN 'رقم الجهاز' WHEN 1 THEN concat('قسم ', event_type) WHEN 2 THEN event_type ELSE 'معدل abc العدوى' END"
_SHARE = "regexp_matches(t, '[؀-ۿ]') AND (length(t) - length(regexp_replace(t, '[؀-ۿ]', '', 'g'))) / length(t) > 0.3"


@both(f"WITH l AS (SELECT event_id, user_id % 2 = 0 AS r, {_ARABIC} AS t FROM events) SELECT event_id, CASE WHEN r AND {_SHARE} THEN array_to_string(list_transform(list_reverse(string_split(t, ' ')), lambda w: reverse(w)), ' ') ELSE t END AS text FROM l")
def turned_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in which the compatibility form changes nothing, so that only the order is looked at."""
    own = _t(spark, sf, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("r"), F.expr(_ARABIC).alias("t"))
    return own.select("event_id", tx.fix_arabic(F.col("t"), F.col("r")).alias("text"))


def _namer(labels: list[str]) -> dict[str, str]:
    """Stands for a model in named_labels; it has no name for purchases."""
    return {x: f"k_{x}" for x in labels if x != "purchase"}


@both("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'fall_rate' WHEN event_type = 'purchase' THEN NULL ELSE concat('k_', event_type) END AS canonical FROM events")
def named_labels(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "Fall rate ").otherwise(F.col("event_type")).alias("text"))
    return harvest.name_unknowns(tx.synonyms(own), _namer).select("event_id", "canonical")


@both("""WITH r AS (SELECT o_custkey AS doc, array_to_string([o_orderstatus, o_orderpriority], ' | ') AS t, o_orderkey FROM orders)
SELECT doc, concat(CASE WHEN doc % 3 > 0 THEN concat('[', CASE WHEN doc % 2 = 0 THEN 'TABLE' ELSE 'FORM' END, '] T', doc, chr(10)) ELSE '' END, CASE WHEN doc % 2 = 0 THEN concat('status | priority', chr(10), repeat('-', 40), chr(10)) ELSE '' END, string_agg(t, chr(10) ORDER BY o_orderkey)) AS text FROM r GROUP BY doc""")
def block_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("c")))), lambda x: x["c"])
    own = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(rows.alias("rows"))
    title = F.when(F.col("doc") % 3 > 0, F.concat(F.lit("T"), F.col("doc").cast("string")))
    headers = F.when(F.col("doc") % 2 == 0, F.array(F.lit("status"), F.lit("priority")))
    return own.select("doc", tx.block_text(F.when(F.col("doc") % 2 == 0, "table").otherwise("form"), title, headers, F.col("rows")).alias("text"))


@both("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS rescued, CASE WHEN event_id % 3 = 0 THEN [] ELSE [concat('Label ', event_type), concat('Item ', event_id)] END AS labels,
CASE WHEN event_id % 3 > 0 THEN concat('{"sections": [{"label": "Label ', event_type, '"}], "title": "Item ', event_id, '"}') END AS form FROM events""".replace("CASE WHEN event_id % 3 = 0 THEN [] ELSE [concat('Label ', event_type), concat('Item ', event_id)] END", "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('Label ', event_type, '|Item ', event_id) END"))
def harvested_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON in the midst of a model's answer; and the form and labels of a nested document."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no object { here "), "props")).otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")))
    form = F.concat(F.lit('{"a": [{"b": {"sections": [{"label": "Label '), "event_type", F.lit('"}], "title": "Item '), F.col("event_id").cast("string"), F.lit('"}}], "title": "x"}'))
    own = _t(spark, sf, "events").select("event_id", said.alias("said"), F.when(F.col("event_id") % 3 == 0, "[1, {").otherwise(form).alias("doc"))
    return own.select("event_id", harvest.rescue_json(F.col("said")).alias("rescued"), F.array_join(harvest.labels(F.col("doc")), "|").alias("labels"), harvest.find_form(F.col("doc")).alias("form"))


# --- forms --------------------------------------------------------------------------
_KINDS = (*tx.WIDGETS[:12], "odd")
_FIELD_SQL = f"f AS (SELECT p_partkey % 20 AS doc, p_partkey % 3 AS page, p_partkey // 40 % 5 AS row, p_partkey AS col, CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ':') ELSE p_name END AS label, ([{', '.join(repr(k) for k in _KINDS)}])[p_partkey % 13 + 1] AS widget, p_partkey % 2 = 1 AS has, p_size / 50.0e0 AS confidence, p_partkey % 20 % 2 = 0 AS rtl FROM part)"
_COMPONENT_SQL = "CASE widget " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in render.COMPONENTS.items()) + " ELSE 'textfield' END"
_KEY_SQL = "concat('f_', substr(sha256(concat_ws('|', doc, page, row, col)), 1, {n}))"


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.array(*[F.lit(w) for w in _KINDS])[(k % 13).cast("int")]
    named = F.when(k % 4 == 0, F.concat("p_name", F.lit(":"))).otherwise(F.col("p_name"))
    return _t(spark, sf, "part").select((k % 20).alias("doc_id"), (k % 3).alias("page"), (F.floor(k / 40) % 5).alias("row"), k.alias("col"), named.alias("label"), kind.alias("widget"), F.when(k % 2 == 1, F.array(F.lit("yes"), F.lit("no"))).alias("options"), (F.col("p_size") / 50).alias("confidence"), (k % 20 % 2 == 0).alias("rtl"))


@both(f"""WITH {_FIELD_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc, page, row) AS n, row_number() OVER (PARTITION BY doc, page, row ORDER BY CASE WHEN rtl THEN -col ELSE col END) AS place FROM f)
SELECT doc AS doc_id, page, row, col, cast(place AS integer) AS place, cast(CASE WHEN n = 1 THEN 12 ELSE greatest(1, 12 // n) + CASE WHEN place = 1 AND 12 - greatest(1, 12 // n) * n > 0 THEN 1 ELSE 0 END END AS integer) AS width,
CASE WHEN widget IN ('radio', 'select') AND NOT has THEN 'textfield' ELSE {_COMPONENT_SQL} END AS type, {_KEY_SQL.format(n=32)} AS key, CASE widget WHEN 'date' THEN 'yyyy-MM-dd' WHEN 'datetime' THEN 'yyyy-MM-dd HH:mm' END AS format,
CASE WHEN widget IN ('radio', 'select') AND has THEN 'yes=opt_0,no=opt_1' END AS options FROM n""")
def form_components(spark: SparkSession, sf: str) -> DataFrame:
    out = render.form_rows(_fields(spark, sf))
    named = F.array_join(F.transform("values", lambda v: F.concat_ws("=", v["label"], v["value"])), ",")
    return out.select("doc_id", "page", "row", "col", "place", "width", "type", "key", "format", named.alias("options"))


_ITEM_SQL = f"""concat('{{"type":"', CASE WHEN widget IN ('radio', 'select') AND NOT has THEN 'textfield' ELSE {_COMPONENT_SQL} END, '"', CASE widget WHEN 'date' THEN ',"format":"yyyy-MM-dd"' WHEN 'datetime' THEN ',"format":"yyyy-MM-dd HH:mm"' ELSE '' END,
 ',"key":"', {_KEY_SQL.format(n=32)}, '","label":"', label, '","width":', CASE WHEN n = 1 THEN 12 ELSE greatest(1, 12 // n) + CASE WHEN place = 1 AND 12 - greatest(1, 12 // n) * n > 0 THEN 1 ELSE 0 END END,
 CASE WHEN widget IN ('radio', 'select') AND has THEN ',"values":[{{"label":"yes","value":"opt_0"}},{{"label":"no","value":"opt_1"}}]' ELSE '' END, ',"properties":{{"confidence":', round(confidence, 3), ',"row_index":', row, ',"col_index":', col, '}}}}')"""


@both(f"""WITH {_FIELD_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc, page, row) AS n, row_number() OVER (PARTITION BY doc, page, row ORDER BY CASE WHEN rtl THEN -col ELSE col END) AS place FROM f),
r AS (SELECT doc, page, row, concat('{{"row":', row, ',"columns":[', string_agg({_ITEM_SQL}, ',' ORDER BY place), ']}}') AS j FROM n GROUP BY doc, page, row),
p AS (SELECT doc, page, concat('{{"page":', page, ',"rows":[', string_agg(j, ',' ORDER BY row), ']}}') AS j FROM r GROUP BY doc, page)
SELECT doc AS doc_id, concat('{{"display":"form","components":[', string_agg(j, ',' ORDER BY page), ']}}') AS form FROM p GROUP BY doc""")
def form_documents(spark: SparkSession, sf: str) -> DataFrame:
    return render.form_json(_fields(spark, sf))


@both(f"""WITH {_FIELD_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc, page, row) AS n, row_number() OVER (PARTITION BY doc, page, row ORDER BY col) AS place, max(page) OVER (PARTITION BY doc) + 1 AS pages FROM f),
s AS (SELECT *, n = 1 AND NOT contains(label, ':') AND widget = 'text' AS still FROM n)
SELECT doc AS doc_id, page, row, col, cast(place AS integer) AS place, CASE WHEN still THEN 'htmlelement' WHEN widget = 'date' THEN 'datetime' WHEN widget IN ('number', 'checkbox', 'textarea', 'select') THEN widget ELSE 'textfield' END AS type,
CASE WHEN still THEN 'h4' END AS tag, {_KEY_SQL.format(n=16)} AS key, label AS text, cast(CASE WHEN n > 1 THEN 12 // n + CASE WHEN place = 1 THEN 12 % n ELSE 0 END END AS integer) AS width,
CASE WHEN pages > 1 THEN concat('page', page + 1) END AS panel, CASE WHEN pages > 1 THEN 'wizard' ELSE 'form' END AS display, widget = 'select' AND has AS has_values FROM s""")
def client_forms(spark: SparkSession, sf: str) -> DataFrame:
    return render.client_rows(_fields(spark, sf)).withColumn("has_values", F.col("values").isNotNull()).drop("values")


_SEM = tuple(render.SEMANTIC)
_SCHEMA_SQL = f"""c AS (SELECT o_custkey AS doc, o_custkey % 3 AS sec, o_orderkey, concat('k', o_orderkey) AS key, concat('L ', o_orderpriority) AS label, ([{', '.join(repr(k) for k in _SEM)}])[o_orderkey % 9 + 1] AS ft, o_orderkey % 4 = 0 AS is_fatal, o_orderkey % 2 = 0 AS required, o_orderkey % 5 = 0 AS own FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY o_orderkey) - 1 AS pos FROM c)"""


def _schemas(spark: SparkSession, sf: str) -> DataFrame:
    """A schema per customer, of one section with a field per order."""
    k = F.col("o_orderkey")
    option = F.array(F.struct(F.lit("a").alias("value"), F.lit("A").alias("label")))
    field = F.struct(k.alias("_o"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.concat(F.lit("L "), "o_orderpriority").alias("label"), F.array(*[F.lit(s) for s in _SEM])[(k % 9).cast("int")].alias("field_type"), (k % 4 == 0).alias("is_fatal"), (k % 2 == 0).alias("required"), F.when(k % 5 == 0, option).alias("options"))
    own = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(field)).alias("f"))
    section = F.struct(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("id"), F.concat(F.lit("Part "), (F.col("doc_id") % 3).cast("string")).alias("label"), F.col("f").alias("fields"))
    return own.select("doc_id", F.array(section).alias("sections"))


@both(f"""WITH {_SCHEMA_SQL} SELECT doc AS doc_id, cast(pos AS integer) AS field_no, concat('section_s', sec) AS panel, CASE ft {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in render.SEMANTIC.items())} END AS type, key, CASE WHEN ft <> 'kpi_indicator' THEN label END AS label,
CASE WHEN ft <> 'kpi_indicator' THEN required END AS required, CASE WHEN ft = 'kpi_indicator' THEN 'kpi-indicator' WHEN is_fatal THEN 'fatal-field' ELSE '' END AS css,
CASE WHEN ft IN ('pass_fail', 'select', 'multiselect') AND own THEN 'a=A' WHEN ft = 'pass_fail' THEN 'pass=Pass,fail=Fail' END AS options, CASE WHEN ft = 'kpi_indicator' THEN concat('<span class="kpi-label">', label, '</span>') END AS content FROM n""")
def canonical_forms(spark: SparkSession, sf: str) -> DataFrame:
    out = render.canonical_components(_schemas(spark, sf))
    named = F.array_join(F.transform("values", lambda v: F.concat_ws("=", v["value"], v["label"])), ",")
    return out.select("doc_id", "field_no", "panel", "type", "key", "label", "required", "css", named.alias("options"), "content")


@both(f"WITH {_SCHEMA_SQL} SELECT doc AS doc_id, cast(pos AS integer) AS pos, key, label, is_fatal FROM n WHERE ft <> 'kpi_indicator'")
def form_criteria(spark: SparkSession, sf: str) -> DataFrame:
    return render.flat_criteria(_schemas(spark, sf))


@both(f"""WITH {_SCHEMA_SQL}, f AS (SELECT doc, sec, string_agg(concat_ws(chr(31), concat('field_type=', ft), concat('is_fatal=', is_fatal), concat('key=', key), concat('label=', label)), chr(30) ORDER BY o_orderkey) AS t FROM n GROUP BY doc, sec)
SELECT doc AS doc_id, sha256(concat('id=s', sec, chr(30), 'label=Part ', sec, chr(30), t)) AS schema_hash FROM f""")
def schema_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _schemas(spark, sf).select("doc_id", render.schema_hash(F.col("sections")).alias("schema_hash"))


@both("""WITH u AS (SELECT l_orderkey, l_returnflag AS label, l_linenumber AS pos, l_partkey AS p, CASE WHEN n = 0 THEN l_returnflag ELSE concat(l_returnflag, '_', n) END AS key FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) - 1 AS n FROM lineitem)),
last AS (SELECT l_orderkey, label, arg_max(key, (cast(pos AS bigint) * 1000000000 + p, key)) AS key FROM u GROUP BY 1, 2)
SELECT c.o_orderkey, c.label, coalesce(last.key, concat('own', o_orderkey)) AS key FROM (SELECT o_orderkey, unnest(['A', 'N', 'X']) AS label FROM orders) c LEFT JOIN last ON c.o_orderkey = last.l_orderkey AND c.label = last.label""")
def realigned_criteria(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "lineitem").withColumn("_o", F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    parts = render.unique_keys(items, ["l_orderkey"], "l_returnflag", "_o").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), "unique_key", (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("pos"))
    own = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("own"), F.col("o_orderkey").cast("string")).alias("key"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("X"))).alias("label"))
    return render.realigned(own, parts, ["o_orderkey"]).select("o_orderkey", "label", "key")


_CANON_SQL = """c AS (SELECT o_custkey AS doc, sha256(concat('f', o_orderkey)) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'checkbox' ELSE 'text' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'true' ELSE o_orderstatus END AS value FROM orders)"""


@both(f"""WITH {_CANON_SQL} SELECT doc, concat('{{"display":"form","components":[{{"type":"panel","title":"Main Content","components":[', string_agg(concat('{{"key":"Field_', substr(id, 1, 8), '","label":"Field_', substr(id, 1, 8), '","defaultValue":"', value, '","type":"', CASE WHEN type = 'checkbox' THEN 'checkbox' ELSE 'textfield' END, '"}}'), ',' ORDER BY id), ']}}]}}') AS form FROM c GROUP BY doc""")
def panel_documents(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 3 == 0, "[X]").otherwise(F.col("o_orderstatus"))
    own = _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.sha2(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), 256).alias("field_id"), value.alias("value"), F.lit(0.9).alias("final"))
    return render.panels(render.canonical_documents(own, "doc"), "doc")


@both(with_views("""c AS (SELECT page, cast(floor(y1 / 40) AS integer) AS row, cast(floor(x1 / 100) AS integer) AS col, min(CASE WHEN cast(floor(y1 / 40) AS integer) % 3 = 1 THEN ' ' ELSE text END) AS text, round(min(confidence), 4) AS confidence FROM tokens GROUP BY ALL)
SELECT page, row, string_agg(concat(text, '/', confidence), ',' ORDER BY col) AS cells, row = 0 AND bool_and(trim(text) <> '') AS is_header FROM c GROUP BY page, row HAVING bool_or(trim(text) <> '')""", "tokens"))
def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    row = F.floor(F.col("y1") / 40).cast("int")
    c = tokens(spark, sf).groupBy("page", row.alias("row"), F.floor(F.col("x1") / 100).cast("int").alias("col")).agg(F.min(F.when(row % 3 == 1, " ").otherwise(F.col("text"))).alias("text"), F.min("confidence").alias("confidence"))
    return render.table_rows(c).select("page", "row", F.array_join(F.transform("cells", lambda x: F.concat_ws("/", x["text"], x["confidence"].cast("string"))), ",").alias("cells"), "is_header")


# --- runs, stores and plans ---------------------------------------------------------
def _run(spark: SparkSession, sf: str) -> stages.Run:
    return stages.Run(spark, stages.evidence_plan()).start(tokens=tokens(spark, sf), regions=regions(spark, sf))


_STAGES = "SELECT 'patched_regions' AS stage, 0 AS place, (SELECT count(*) FROM regions) AS n UNION ALL SELECT 'alignments', 1, (SELECT count(*) FROM alignments) UNION ALL SELECT 'fields', 2, (SELECT count(*) FROM (SELECT DISTINCT page, region_id FROM alignments)) UNION ALL SELECT 'valued_fields', 3, (SELECT count(*) FROM (SELECT DISTINCT page, region_id FROM alignments))"


@both(with_views(_ALIGN + f"SELECT 'r1' AS run_id, stage, place, n FROM ({_STAGES})", "tokens", "regions"))
def run_export(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).export("r1").select("run_id", "stage", "place", "n")


@both(with_views(_ALIGN + f"SELECT stage, n, true AS same FROM ({_STAGES}) WHERE place > 0", "tokens", "regions"))
def replayed_stages(spark: SparkSession, sf: str) -> DataFrame:
    """A run whose alignments and all after them are made again, from tokens in another order."""
    run = _run(spark, sf)
    before = run.export("a")
    again = run.rerun_from("alignments", tokens=tokens(spark, sf).repartition(5, "token_id")).export("b").select("stage", *[F.col(c).alias(f"_{c}") for c in ("n", "parity", "total")])
    same = (F.col("n") == F.col("_n")) & (F.col("parity") == F.col("_parity")) & (F.col("total") == F.col("_total"))
    return before.where("place > 0").join(again, "stage").select("stage", "n", same.alias("same"))


@both(with_views("SELECT page, count(*) AS n, round(avg(confidence), 6) AS confidence, min(x1) AS x1, max(y2) AS y2, min(text) AS text FROM tokens GROUP BY page", "tokens"))
def token_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)
    return run.snapshot("tokens").groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.min("text").alias("text"))


@both(with_views(_ALIGN + "SELECT page, region_id, count(*) AS n, round(max(score), 4) AS best FROM alignments GROUP BY page, region_id", "tokens", "regions"))
def alignment_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).snapshot("alignments").groupBy("page", "region_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"))


@both(with_views(_CELLS + """, lang AS (SELECT page, count(*) AS n, count(*) FILTER (source = 'native') AS nat FROM tokens GROUP BY page)
SELECT c.page, cast(max(col) + 1 AS integer) AS n_cols, cast(max(row) + 1 AS integer) AS n_rows, count(*) AS n_cells, CASE WHEN any_value(nat) = any_value(n) THEN 'native' WHEN any_value(nat) = 0 THEN 'ocr' ELSE 'hybrid' END AS mode, count(*) FILTER (confidence < 0.65) AS n_issues FROM cells c JOIN lang USING (page) GROUP BY c.page""", "tokens"))
def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with a broken page for every tenth; the others go on to a fingerprint."""
    sized = tokens(spark, sf).withColumns({"page_w": F.lit(PAGE_W + 1000), "page_h": F.lit(PAGE_H + 1000), "error": F.lit(None).cast("string")})
    broken = sized.where("page % 10 = 0").select("page").distinct().select(*[(F.col("page") + 1_000_000).alias("page") if c == "page" else F.lit("no page").alias(c) if c == "error" else F.lit(None).cast(dict(sized.dtypes)[c]).alias(c) for c in sized.columns])
    run = stages.Run(spark, stages.document_plan()).start(scanned=sized.unionByName(broken))
    return run.tables["fingerprints"].select("page", "n_cols", "n_rows", "n_cells", "mode", "n_issues")


@both("SELECT DISTINCT p_size AS size, concat('a', p_size) AS artifact_id FROM part WHERE p_size > 30")
def written_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """What a write-once store takes that has the artifacts of small parts already."""
    new = _t(spark, sf, "part").select(F.col("p_size").alias("size"), F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("artifact_id"))
    return state.write_once(new.where("size <= 30").distinct(), new).select("size", "artifact_id")


_OPERATIONS = (*state.OPERATION_FIELDS, "unknown")
_KIND_SQL = _pick_sql("event_id", _OPERATIONS)


@both(f"""SELECT event_id, k AS operation_type, CASE WHEN k = 'unknown' THEN 'operation_type' WHEN k = 'region_merge' THEN CASE WHEN user_id % 2 = 0 THEN 'source_regions' ELSE '' END WHEN k = 'region_split' THEN 'source_region,split_coordinates' WHEN k = 'token_reassignment' THEN CASE WHEN user_id % 2 = 0 THEN 'token_id,new_region_id' ELSE 'new_region_id' END
WHEN k = 'checkbox_correction' THEN CASE WHEN user_id % 2 = 0 THEN 'region_id,new_state' ELSE 'new_state' END ELSE '' END AS missing FROM (SELECT *, {_KIND_SQL} AS k FROM events)""")
def checked_operations(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("user_id") % 2 == 1, F.create_map(*[F.lit(x) for k in ("source_regions", "token_id", "region_id") for x in (k, "1")]))
    own = _t(spark, sf, "events").select("event_id", _pick("event_id", _OPERATIONS).alias("operation_type"), given.alias("payload"))
    return state.validate_operations(own).select("event_id", "operation_type", F.array_join("missing", ",").alias("missing"))


@both(f"""WITH f AS (SELECT doc_id, ext, {_ROUTE_SQL} AS route, 0.95e0 - doc_id % 5 / 10.0e0 AS c FROM (SELECT *, {_EXT_SQL} AS ext FROM documents)),
e AS (SELECT *, CASE WHEN route IS NULL THEN concat('no reader for ', ext) WHEN doc_id % 11 = 0 THEN 'ValueError: broken' WHEN doc_id % 13 = 0 THEN 'no contents' END AS error FROM f)
SELECT doc_id, error, CASE WHEN error IS NULL THEN CASE WHEN c >= 0.9 THEN 'AUTO_PASS' WHEN c >= 0.7 THEN 'QA_REVIEW' ELSE 'QUARANTINE' END END AS outcome, CASE WHEN error IS NOT NULL THEN 'error' WHEN c < 0.7 THEN 'quarantined' ELSE 'pass' END AS status FROM e""")
def ingested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Files of many types, some without a reader, broken or empty, each with its own outcome."""
    d = _t(spark, sf, "documents").withColumn("path", F.concat(F.lit("/l/s/"), F.col("doc_id").cast("string"), F.lit("."), _pick("doc_id", _EXTS)))
    broken, empty = F.col("doc_id") % 11 == 0, F.col("doc_id") % 13 == 0
    blocks = d.where(broken | ~empty).select("path", F.when(~broken, F.col("text")).alias("text"), F.when(~broken, 0.95 - F.col("doc_id") % 5 / 10.0).alias("confidence"), F.when(broken, "ValueError: broken").alias("error"))
    out = stages.ingest(readers.named_files(d.select("path")), blocks)
    number = F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1)).cast("long")
    return out.select(number.alias("doc_id"), F.when(F.col("error").startswith("no reader"), F.concat(F.lit("no reader for "), F.element_at(F.split("path", r"\."), -1))).otherwise(F.col("error")).alias("error"), "outcome", "status")


@both("SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 < 5 THEN ts + to_seconds(cast(power(2, event_id % 7) * 60 AS bigint)) END AS retry_at, event_id % 7 >= 5 AS exhausted FROM events WHERE event_type = 'error'")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    out = state.dead_letters(_t(spark, sf, "events").withColumn("attempts", F.col("event_id") % 7), F.col("event_type") == "error", "ts")[1]
    return out.select("event_id", "user_id", "event_type", "retry_at", "exhausted")


@both(with_views("SELECT page, 'token' AS layer, count(*) AS n FROM tokens GROUP BY page UNION ALL SELECT page, 'region', count(*) FROM regions GROUP BY page UNION ALL SELECT page, concat(orientation, '_line'), count(*) FROM lines GROUP BY page, orientation", "tokens", "regions", "lines"))
def geometry_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stages.geometry_counts(tokens(spark, sf), regions(spark, sf), lines(spark, sf))


@both(with_views("""o AS (SELECT page, 'token' AS layer, x1, y1, x2, y2 FROM tokens UNION ALL SELECT page, 'region', x1, y1, x2, y2 FROM regions UNION ALL
SELECT page, 'line', CASE WHEN orientation = 'horizontal' THEN start ELSE axis END, CASE WHEN orientation = 'horizontal' THEN axis ELSE start END, CASE WHEN orientation = 'horizontal' THEN stop ELSE axis END, CASE WHEN orientation = 'horizontal' THEN axis ELSE stop END FROM lines)
SELECT page, layer, CASE layer WHEN 'token' THEN '#00ff00' WHEN 'region' THEN '#0000ff' ELSE '#ff0000' END AS color, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM o GROUP BY ALL""", "tokens", "regions", "lines"))
def overlay_layers(spark: SparkSession, sf: str) -> DataFrame:
    out = stages.overlay(tokens(spark, sf), regions(spark, sf), lines(spark, sf), {"token": "#00ff00", "region": "#0000ff", "line": "#ff0000"})
    return out.groupBy("page", "layer", "color").agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@both("SELECT o_custkey AS doc, count(*) AS n_fields, count(*) FILTER (o_totalprice < 100000) AS blocking, count(*) FILTER (o_totalprice < 100000) = 0 AS can_approve, CASE WHEN o_custkey % 17 = 0 THEN 'not a pdf' WHEN o_custkey % 19 = 0 THEN 'over 50 MB' END AS refused FROM orders GROUP BY 1")
def approval_gates(spark: SparkSession, sf: str) -> DataFrame:
    f = _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_totalprice") < 100000).alias("needs_qa"), F.lit(False).alias("human_corrected"))
    gates = state.approvals(f, "doc").select("doc", "n_fields", F.col("open_issues").alias("blocking"), (F.col("open_issues") == 0).alias("can_approve"))
    name = F.when(F.col("doc") % 17 == 0, "a.docx").otherwise("a.PDF")
    return gates.withColumn("refused", quality.upload_refused(name, F.when(F.col("doc") % 19 == 0, 60 << 20).otherwise(1)))


# --- images, models and jobs --------------------------------------------------------
def _drawn(keys):
    """Images of 240 by 200 pixels with a long line each way and a short one."""
    import numpy as np

    def one(k: int) -> bytes:
        gray = np.full((200, 240), 255, np.uint8)
        gray[20 + k % 50 : 22 + k % 50, 10 : 110 + k % 100] = 0
        gray[5 : 85 + k % 60, 225:228] = 30
        gray[150, 20:40] = 0
        return gray.tobytes()

    return keys.map(one)


@both("SELECT s_suppkey AS page, 'horizontal' AS orientation, 21.0e0 + s_suppkey % 50 AS axis, 10.0e0 AS start, 110.0e0 + s_suppkey % 100 AS stop FROM supplier UNION ALL SELECT s_suppkey, 'vertical', 226.5e0, 5.0e0, 85.0e0 + s_suppkey % 60 FROM supplier")
def image_lines(spark: SparkSession, sf: str) -> DataFrame:
    pages = _spread(_t(spark, sf, "supplier").select("s_suppkey")).select(F.col("s_suppkey").alias("page"), F.lit(240).alias("width"), F.lit(200).alias("height"), F.pandas_udf(_drawn, "binary")("s_suppkey").alias("pixels"))
    return images.detect_lines(pages, 100.0).select("page", "orientation", "axis", "start", "stop")


def _answers(texts: list[str]) -> list[str]:
    """Stands for a model in generated_checklists."""
    button = ', {"type": "button", "action": "submit"}'
    return [f'Here: {{"components": [{{"key": "k{len(t)}"}}{button if len(t) % 2 else ""}]}} done' if len(t) % 3 else "I can not say." for t in texts]


@both("""WITH t AS (SELECT doc_id, length(substr(text, 1, 3500)) AS n FROM documents)
SELECT doc_id, CASE WHEN n % 3 > 0 THEN concat('{"components": [{"key": "k', n, '"}', CASE WHEN n % 2 = 1 THEN ', {"action": "submit", "type": "button"}' ELSE ', {"type": "button", "label": "Submit Inspection / إرسال التفتيش", "key": "submit_btn", "size": "md", "block": true, "action": "submit", "disableOnInvalid": true, "theme": "primary"}' END, ']}') END AS form FROM t""")
def generated_checklists(spark: SparkSession, sf: str) -> DataFrame:
    """The model reads the first 3500 characters: the operator's own bound."""
    return harvest.checklists(_t(spark, sf, "documents").select("doc_id", "text"), _answers).select("doc_id", "form")


@both("""WITH now AS (SELECT max(ts) AS n FROM events), e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ingestion' ELSE 'analytics' END AS queue, event_id % 4 AS k, event_id % 11 * 60 AS took, ts FROM events)
SELECT event_id AS job_id, CASE WHEN k = 0 THEN 'queued' WHEN k = 1 THEN CASE WHEN epoch(n) - epoch(ts) > CASE queue WHEN 'ingestion' THEN 600 ELSE 120 END THEN 'failed' ELSE 'started' END
WHEN k = 2 THEN CASE WHEN took > CASE queue WHEN 'ingestion' THEN 600 ELSE 120 END THEN 'failed' ELSE 'finished' END ELSE 'failed' END AS status FROM e, now""")
def job_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that wait, run, ended after some minutes, or failed."""
    e = _t(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 2 == 0, "ingestion").otherwise("analytics").alias("queue"), (F.col("event_id") % 4).alias("k"), "ts", (F.col("event_id") % 11).alias("minutes"))
    ended = F.when(F.col("k") == 2, "finished").when(F.col("k") == 3, "failed")
    after = F.col("ts") + F.make_dt_interval(mins=F.col("minutes").cast("int"))
    begun = e.where("k > 0").select("job_id", F.lit("started").alias("event"), F.col("ts").alias("at"))
    over = e.where("k > 1").select("job_id", ended.alias("event"), after.alias("at"))
    now = e.agg(F.max("ts").alias("_now"))
    return state.job_status(e.select("job_id", "queue").crossJoin(F.broadcast(now)), begun.unionByName(over), F.col("_now")).select("job_id", "status")
