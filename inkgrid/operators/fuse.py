"""Fusion of alignments into resolved fields, by closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

# Weights of alignment classes and of the final score.
EDGE_WEIGHTS = {"inside": 1.0, "touching": 0.6, "crosses": 0.2}


def consolidate(alignments: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Per region: n alignments, k inside, greatest score, conflicts.

    Each ordered pair of inside alignments of a region is a conflict, and so is
    each other unordered pair: with n alignments, k of them inside, these are
    n(n-1)/2 + k(k-1)/2, so no pairs are made."""
    n, k = F.col("n"), F.col("k")
    per = alignments.groupBy(*on, "region_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cls") == "inside").alias("k"), F.max("score").alias("best"))
    return per.withColumn("conflicts", ((n * (n - 1) + k * (k - 1)) / 2).cast("long"))


def final_score(geometry: Column, alignment: Column, text: Column, anchor: Column, conflict: Column, human: Column) -> Column:
    raw = 0.4 * geometry + 0.4 * alignment + 0.2 * text - anchor - conflict + human
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def resolve(consolidated: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """A field per region, with the penalty for conflicts and the final score."""
    penalty = F.least(F.lit(0.4), 0.1 * F.col("conflicts"))
    zero = F.lit(0.0)
    out = consolidated.withColumn("penalty", penalty)
    return out.withColumn("final", F.round(final_score(F.col("best"), F.col("best"), zero, zero, F.col("penalty"), zero), 6)).withColumn("field_id", stable_id(*[F.col(c) for c in on], F.col("region_id")))


def edge_confidence(edges: DataFrame) -> DataFrame:
    """Per target node: 0.1 of the weight of support, 0.2 of that of conflict, human."""
    part = lambda kind, by: F.sum(F.when(F.col("edge_type") == kind, by * F.col("weight")).otherwise(0.0))
    return edges.groupBy("target").agg(part("supports", 0.1).alias("support"), part("conflicts", 0.2).alias("conflict"), F.max((F.col("edge_type") == "human").cast("int")).alias("human"))


def conflict_edges(alignments: DataFrame, existing: DataFrame | None = None, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """The pairs of alignments of a region that have no edge yet, at weight 0.5. Only
    for looking at single regions: counts come from consolidate."""
    a = alignments.select(*on, "region_id", F.col("token_id").alias("a"))
    b = alignments.select(*on, "region_id", F.col("token_id").alias("b"))
    pairs = a.join(b, [*on, "region_id"]).where("a < b").withColumn("weight", F.lit(0.5))
    return pairs if existing is None else pairs.join(existing.select(*on, "region_id", "a", "b"), [*on, "region_id", "a", "b"], "left_anti")


def with_values(fields: DataFrame, alignments: DataFrame, tokens: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Adds the text of the inside tokens of each region, in reading order."""
    inside = alignments.where("cls = 'inside'").join(tokens.select(*on, "token_id", "x1", "y1", "text"), [*on, "token_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "token_id", "text"))), lambda t: t["text"]), " ")
    return fields.join(inside.groupBy(*on, "region_id").agg(text.alias("value")), [*on, "region_id"], "left")


def alignment_view(alignments: DataFrame, tokens: DataFrame, regions: DataFrame, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Each alignment with the text and box of its token and the box of its region."""
    box = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]
    own = tokens.select(*on, "token_id", "text", *box("token"))
    return alignments.join(own, [*on, "token_id"]).join(regions.select(*on, "region_id", *box("region")).hint("merge"), [*on, "region_id"])


def first_tokens(fields: DataFrame, tokens: DataFrame, ids: str = "token_ids", on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Fields with the text of the first of their tokens that exists."""
    named = fields.select(*on, "field_id", F.posexplode(ids).alias("_at", "token_id")).join(tokens.select(*on, "token_id", "text"), [*on, "token_id"])
    first = named.groupBy(*on, "field_id").agg(F.min_by("text", "_at").alias("first_text"))
    return fields.join(first, [*on, "field_id"], "left")
