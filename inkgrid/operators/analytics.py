"""Compliance figures, counters, lookups and top-k, as aggregates and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(logs: DataFrame, since: Column) -> DataFrame:
    """Submissions since a time, fatal ones, and the pass rate (0 without any)."""
    n, fatal = F.count(F.lit(1)), F.count_if("has_fatal_failure")
    rate = F.when(n > 0, F.round((n - fatal) / n, 4)).otherwise(0.0)
    return logs.where(F.col("created_at") >= since).agg(n.alias("total_submissions"), fatal.alias("fatal_failures"), rate.alias("pass_rate"))


def by_source(logs: DataFrame, since: Column) -> DataFrame:
    return logs.where(F.col("created_at") >= since).groupBy("submission_source").agg(F.count(F.lit(1)).alias("cnt"))


def by_version(logs: DataFrame) -> DataFrame:
    return logs.where("schema_version is not null").groupBy("schema_version").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "schema_version")


def failing_criteria(logs: DataFrame, since: Column, failed: str = "fail", top: int = 10) -> DataFrame:
    """The criteria of most failures; the answers are a JSON object of strings."""
    answers = logs.where(F.col("created_at") >= since).select(F.explode(F.from_json("inspection_data", "map<string,string>")).alias("key", "value"))
    return answers.where(F.col("value") == failed).groupBy("key").agg(F.count(F.lit(1)).alias("fail_count")).orderBy(F.col("fail_count").desc(), "key").limit(top)


def layer_counts(hypotheses: DataFrame) -> DataFrame:
    """Counts by type, with those accepted and rejected."""
    return hypotheses.groupBy("hypothesis_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def structure(rows: DataFrame) -> DataFrame:
    """Department to devices with their sorted sets of form types and sources, without
    empty departments; missing names are General and unknown."""
    clean = rows.where(F.col("department").isNotNull() & ~F.col("department").isin("None", "null"))
    return clean.groupBy("department", F.coalesce("device", F.lit("General")).alias("device")).agg(F.sort_array(F.collect_set(F.coalesce("form_type", F.lit("unknown")))).alias("form_types"), F.sort_array(F.collect_set("source")).alias("sources"))


def produced_stages(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected stages that were produced under their name or their type: two equi-joins
    instead of one on either."""
    names = produced.select(F.col("stage_name").alias("name")).distinct().withColumn("_n", F.lit(True))
    types = produced.select(F.col("artifact_type").alias("type")).distinct().withColumn("_t", F.lit(True))
    out = expected.join(names, "name", "left").join(types, "type", "left")
    return out.select("name", "type", (F.coalesce("_n", F.lit(False)) | F.coalesce("_t", F.lit(False))).alias("produced"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


# Sources, scores and hints of the kinds of layout hypotheses. A score is a
# number, or the name of the column it is taken from.
KINDS = {
    "checkbox": {"type": "checkbox", "sources": ("opencv_morphology",), "geometry": "geometry_score", "text": 0.0, "with_text": 0.0, "structure": 0.5, "hint": "checkbox"},
    "table_cell": {"type": "table_cell", "sources": ("structural_grid",), "geometry": "geometry_score", "text": 0.0, "with_text": 0.0, "structure": "structural_score", "hint": "text"},
    "text_block": {"type": "text_block", "sources": ("native_text",), "geometry": 0.3, "text": "text_confidence", "with_text": "text_confidence", "structure": 0.0, "hint": "text"},
    "section_header": {"type": "section_header", "sources": ("opencv_morphology", "structural_anchor"), "geometry": 0.8, "text": 0.0, "with_text": 0.6, "structure": 0.85, "hint": "text"},
    "radio_group": {"type": "radio_group", "sources": ("opencv_morphology", "alignment_pattern"), "geometry": "alignment", "text": 0.0, "with_text": 0.5, "structure": 0.65, "hint": "radio"},
    "merged_cell": {"type": "table_cell", "sources": ("structural_grid", "cell_merger"), "geometry": "confidence", "text": 0.0, "with_text": 0.0, "structure": 0.80, "hint": "span"},
    "signature": {"type": "signature_area", "sources": ("opencv_morphology", "fill_ratio_analysis"), "geometry": "fill", "text": 0.0, "with_text": 0.3, "structure": 0.55, "hint": "signature"},
}
# What a detector's figure says of the geometry.
PRIORS = {
    "alignment": lambda c: F.least(F.lit(0.95), c * 1.1),
    "fill": lambda c: F.greatest(F.lit(0.5), 1 - c * 2.5),
}


def hypotheses(boxes: DataFrame, kind: str) -> DataFrame:
    """Boxes as layout hypotheses of a kind, with its priors; none is accepted yet. The kind's
    figures are columns of boxes; `near_text` says what stands by, if the column is there."""
    k = KINDS[kind]
    near = F.col("near_text") if "near_text" in boxes.columns else F.lit(None).cast("string")
    one = lambda v: F.lit(v) if isinstance(v, float) else PRIORS[v](F.col(v)) if v in PRIORS else F.col(v).cast("double")
    said = F.when(F.coalesce(near, F.lit("")) != "", one(k["with_text"])).otherwise(one(k["text"]))
    hint = F.concat(F.lit("span_"), F.col("rowspan").cast("string"), F.lit("r_"), F.col("colspan").cast("string"), F.lit("c")) if kind == "merged_cell" else F.lit(k["hint"])
    scores = {"geometry_score": one(k["geometry"]), "text_score": said, "structural_score": one(k["structure"])}
    out = boxes.select(*[c for c in boxes.columns if c not in scores], *[v.alias(c) for c, v in scores.items()])
    fused = F.least(F.lit(1.0), 0.35 * F.col("geometry_score") + 0.45 * F.col("text_score") + 0.20 * F.col("structural_score"))
    return out.withColumns({"hypothesis_type": F.lit(k["type"]), "evidence_sources": F.array(*map(F.lit, k["sources"])), "widget_hint": hint, "text_content": near, "fusion_score": F.round(fused, 4), "accepted": F.lit(False)})


def registry(submitted: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """The hypotheses of each page's registry in order of submission (`place`), with the latest
    decision on each; those without one aren't accepted. An id that is submitted again stands
    at both places with its latest contents. decisions: hypothesis_id, accepted, seq."""
    from .state import latest_wins

    own = [c for c in submitted.columns if c not in (*order, "accepted")]
    last = latest_wins(submitted.select("hypothesis_id", *order, F.struct(*[c for c in own if c != "hypothesis_id"]).alias("_b")), ["hypothesis_id"], order).select("hypothesis_id", "_b.*")
    said = latest_wins(decisions.select("hypothesis_id", "seq", "accepted"), ["hypothesis_id"], ["seq"]).drop("seq")
    placed = submitted.select("page", "hypothesis_id", F.row_number().over(Window.partitionBy("page").orderBy(*order)).alias("place"))
    return placed.join(last.drop("page"), "hypothesis_id").join(said, "hypothesis_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def of_type(rows: DataFrame, kind: str | None = None, page: int | None = None, accepted: bool | None = None) -> DataFrame:
    """The registered hypotheses of a type, a page or a verdict."""
    for c, v in (("hypothesis_type", kind), ("page", page), ("accepted", accepted)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows
