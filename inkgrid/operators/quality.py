"""Validation, hierarchical confidence, gates and governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a null rule counts as kept."""
    return F.array_compact(F.array(*[F.when(~cond, F.lit(name)) for name, cond in rules.items()]))


def box_rules() -> dict[str, Column]:
    return {"x2 must exceed x1": F.col("x2") > F.col("x1"), "y2 must exceed y1": F.col("y2") > F.col("y1"), "confidence must be in [0, 1]": F.col("confidence").between(0, 1)}


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their violations."""
    marked = df.withColumn("violations", violations(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def mean_of_means(df: DataFrame, levels: list[str], value: str = "confidence") -> DataFrame:
    """The unweighted mean at the first level of means at the next, and so on down."""
    keys, out = list(levels), df.select(*levels, F.col(value).alias("m"))
    while keys:
        out = out.groupBy(*keys).agg(F.avg("m").alias("m"))
        keys = keys[:-1]
    return out.select(levels[0], F.col("m").alias("mean"))


def quarantine(docs: DataFrame, least: float = 0.6, most_empty: float = 0.5, slack: float = 0.8) -> DataFrame:
    """Gate status from avg_confidence, n_blocks, n_empty_blocks, n_cells, n_empty_cells,
    n_boxed_cells and file_type: pass; warning for one violation at a confidence of
    0.8 of the least or more; else hard_stop."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("avg_confidence") < least, "confidence"), F.when(F.col("n_blocks") == 0, "no blocks"),
            F.when((F.col("file_type") == "pdf") & (F.col("n_cells") > 0) & (F.col("n_boxed_cells") == 0), "no boxes"),
            F.when(F.col("n_empty_cells") > most_empty * F.col("n_cells"), "empty cells"),
        )
    )
    n = F.size("violations") + F.col("n_empty_blocks")
    status = F.when(n == 0, "pass").when((n == 1) & (F.col("avg_confidence") >= least * slack), "warning").otherwise("hard_stop")
    return docs.withColumn("violations", rules).withColumn("n_violations", n.cast("int")).withColumn("status", status)


def governance(confidence: Column, automatic: float = 0.90, review: float = 0.70) -> Column:
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= automatic, "AUTO_PASS").when(F.coalesce(confidence, F.lit(0.0)) >= review, "QA_REVIEW").otherwise("QUARANTINE")


def extraction_mode(native: Column, total: Column) -> Column:
    return F.when(native == total, "native").when(native == 0, "ocr").otherwise("hybrid")


def upload_refused(name: Column, n_bytes: Column, most_mb: int = 50) -> Column:
    """Why a document isn't taken; null if it is."""
    return F.when(~F.lower(name).endswith(".pdf"), "not a pdf").when(n_bytes > most_mb << 20, f"over {most_mb} MB")
