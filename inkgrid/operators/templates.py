"""Layout fingerprints by grid density, drift between them, and reuse of corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

GRID = 10
#: Counts of a cell, and words of 64 cells, that best_templates compares as bits.
LEVELS, WORDS = 16, 2


def density(regions: DataFrame, page_w: float, page_h: float, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """Regions per grid cell, by their centres: on, cell, n."""
    b = g.box()
    part = lambda c, size: F.greatest(F.least(F.floor(c / (size / GRID)), F.lit(GRID - 1)), F.lit(0))
    cell = part(g.y_center(b), page_h) * GRID + part(g.x_center(b), page_w)
    return regions.groupBy(*on, cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def fingerprints(cells: DataFrame, aspect: Column, on: tuple[str, ...] = ("page",)) -> DataFrame:
    """One row per layout: its cells as a map, the count of regions, the aspect ratio."""
    entries = F.array_sort(F.collect_list(F.struct("cell", "n")))
    return cells.groupBy(*on).agg(F.map_from_entries(entries).alias("cells"), F.sum("n").alias("regions")).withColumn("aspect", aspect)


def drift(a_regions: Column, b_regions: Column, a_aspect: Column, b_aspect: Column, divergence: Column) -> Column:
    """0.4 of the relative difference in count, 0.1 in aspect, 0.5 in density."""
    most = F.greatest(a_regions, b_regions)
    raw = 0.4 * F.abs(a_regions - b_regions) / most + 0.1 * F.abs(a_aspect - b_aspect) / F.greatest(a_aspect, b_aspect) + 0.5 * F.least(F.lit(1.0), divergence / (2 * most))
    empty_a, empty_b = a_regions == 0, b_regions == 0
    return F.when(empty_a & empty_b, 0.0).when(empty_a | empty_b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def drift_class(score: Column) -> Column:
    return F.when(score < 0.05, "identical").when(score < 0.20, "minor_drift").when(score < 0.45, "moderate_drift").otherwise("catastrophic_drift")


def pair_drift(pairs: DataFrame, cells: DataFrame, sizes: DataFrame, key: str = "page") -> DataFrame:
    """Drift of stated pairs (a, b) of layouts: a full outer join of their cells, then
    one sum. sizes: key, regions, aspect."""
    left = pairs.join(cells.withColumnsRenamed({key: "a", "n": "na"}), "a")
    right = pairs.join(cells.withColumnsRenamed({key: "b", "n": "nb"}), "b")
    both = left.join(right, ["a", "b", "cell"], "full").groupBy("a", "b").agg(F.sum(F.abs(F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0)))).alias("divergence"))
    size = lambda s: sizes.select(F.col(key).alias(s), F.col("regions").alias(f"{s}_regions"), F.col("aspect").alias(f"{s}_aspect"))
    out = pairs.join(both, ["a", "b"], "left").join(size("a"), "a").join(size("b"), "b")
    score = drift(F.col("a_regions"), F.col("b_regions"), F.col("a_aspect"), F.col("b_aspect"), F.coalesce("divergence", F.lit(0)))
    return out.select("a", "b", F.round(score, 6).alias("drift")).withColumn("drift_class", drift_class(F.col("drift")))


def _bits(cells: str, level: int, word: int) -> Column:
    """The cells word * 64 to word * 64 + 63 of a map that have `level` regions or more, as bits."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c - word * 64).cast("int"))
    own = F.map_keys(F.map_filter(cells, lambda c, n: (n >= level) & c.between(word * 64, word * 64 + 63)))
    return F.aggregate(own, F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(bit(c)))


def best_templates(prints: DataFrame, templates: DataFrame, most: float = 0.3, limit: int = 1000) -> DataFrame:
    """The template of least drift for each layout, up to `most`. Templates are a library, dealt
    into blocks of about `limit`. A library of one block is sent to all tasks; of a larger
    one, each block meets each part of the layouts in a join. All pairs are compared, and only
    the minima are kept: first the least drift, then the first template that has it.

    Two maps differ by their sums less twice what they have in common, and that is the number
    of common bits, of a word for each count up to LEVELS. Only a library with more than this
    in a cell, or other cells than the words have, also compares the rest of its maps.
    Both sides: id, cells (map of counts), regions, aspect."""
    entries = F.map_entries("cells")
    size = templates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.array_max(entries["value"])), F.lit(0)), F.coalesce(F.max(F.array_max(entries["key"])), F.lit(0)), F.coalesce(F.min(F.array_min(entries["key"])), F.lit(0))).first()
    blocks, levels, words = max(1, -(-size[0] // limit)), min(size[1], LEVELS), min(size[2] // 64 + 1, WORDS) if size[2] >= 0 else 0
    rest = size[1] > levels or size[2] >= words * 64 or size[3] < 0
    parts = 1 if blocks == 1 else int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    planes = [(level, word) for level in range(1, levels + 1) for word in range(words)]

    def shaped(df: DataFrame, prefix: str) -> DataFrame:
        more = F.map_filter(F.transform_values("cells", lambda c, n: F.when(c.between(0, words * 64 - 1), n - levels).otherwise(n)), lambda c, n: n > 0)
        whole = F.aggregate(F.map_values("cells"), F.lit(0).cast("long"), lambda s, n: s + n)
        own = [F.col(c).alias(f"{prefix}{c}") for c in ("id", "regions", "aspect")] + [whole.alias(f"{prefix}whole"), *[_bits("cells", *p).alias(f"{prefix}b{k}") for k, p in enumerate(planes)]]
        return df.select(*own, *[more.alias(f"{prefix}rest")] * rest)

    shared = F.lit(0).cast("long")
    for k in range(len(planes)):
        shared += F.bit_count(F.col(f"b{k}").bitwiseAND(F.col(f"t_b{k}"))).cast("long")
    if rest:
        shared += F.aggregate(F.map_keys("t_rest"), F.lit(0).cast("long"), lambda s, c: s + F.least(F.col("t_rest")[c], F.coalesce(F.try_element_at("rest", c), F.lit(0))).cast("long"))
    score = F.round(drift(F.col("regions"), F.col("t_regions"), F.col("aspect"), F.col("t_aspect"), F.col("whole") + F.col("t_whole") - 2 * shared), 6)
    library = shaped(templates, "t_").withColumn("_block", F.pmod(F.xxhash64("t_id"), F.lit(blocks)).cast("int")).withColumn("_part", numbers(parts))
    library = F.broadcast(library) if blocks == 1 else library.hint("shuffle_hash")
    layouts = shaped(prints, "").withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    pairs = lambda df: df.withColumn("_block", numbers(blocks)).join(library, ["_block", "_part"])
    least = pairs(layouts).groupBy("id").agg(F.min(score).alias("drift")).where(F.col("drift") <= most)
    best = pairs(layouts.join(least, "id")).where(F.col("drift") == score)
    return best.groupBy("id", "drift").agg(F.min("t_id").alias("template_id")).select("id", "template_id", "drift")


def suggest_corrections(lineage: DataFrame, runs: DataFrame, most: float = 0.20) -> DataFrame:
    """Past operations of a template offered for its new runs of low drift: pointed at
    the run's first region, with 1 - drift as confidence. runs: run_id, template_id,
    drift, first_region_id."""
    low = runs.where(F.col("drift") <= most)
    out = lineage.join(low, "template_id").where(F.size("target_evidence_ids") > 0)
    return out.select("run_id", "template_id", F.col("operation_id").alias("provenance"), "operation_type", F.array("first_region_id").alias("target_evidence_ids"), F.round(1 - F.col("drift"), 6).alias("confidence"))
