"""Ledgers, lifecycles, latest-wins tables, corrections, approvals, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lifecycle's legal transitions and the states set by people.
TRANSITIONS = {
    "INGESTED": ("EXTRACTED",),
    "EXTRACTED": ("GENERATED", "QUARANTINED"),
    "GENERATED": ("QA_PENDING", "QUARANTINED"),
    "QUARANTINED": ("QA_PENDING", "CLOSED"),
    "QA_PENDING": ("APPROVED", "REJECTED", "QUARANTINED"),
    "REJECTED": ("GENERATED",),
    "APPROVED": ("LIVE", "SUPERSEDED", "CLOSED"),
    "LIVE": ("SUPERSEDED", "CLOSED"),
    "SUPERSEDED": ("CLOSED",),
    "CLOSED": (),
}
HUMAN_STATES = ("APPROVED", "REJECTED", "CLOSED", "QUARANTINED")
OPERATION_FIELDS = {
    "line_approval": (),
    "line_rejection": (),
    "region_merge": ("source_regions",),
    "region_split": ("source_region", "split_coordinates"),
    "token_reassignment": ("token_id", "new_region_id"),
    "checkbox_correction": ("region_id", "new_state"),
}


def is_legal(before: Column, after: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[before], after), F.lit(False))


def transitions(events: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """Each change of a lifecycle with its legality, and a warning where a state for
    people is set by the system. An entity's first state must be INGESTED."""
    w = Window.partitionBy(key).orderBy(*order)
    out = events.withColumn("from_state", F.lag(state).over(w))
    legal = F.when(F.col("from_state").isNull(), F.col(state) == "INGESTED").otherwise(is_legal(F.col("from_state"), F.col(state)))
    warn = F.col(state).isin(*HUMAN_STATES) & ~F.coalesce(F.col("actor").startswith("user:"), F.lit(False)) if "actor" in events.columns else F.lit(False)
    return out.withColumn("legal", legal).withColumn("needs_human", warn)


def first_wins(ops: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """An append-only ledger: the first row of each id, and the duplicates that are refused."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = ops.withColumn("_n", F.row_number().over(w))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def latest_wins(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key: an upsert over an append-only table. An aggregate,
    so that a key with very many versions is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(version)], F.struct(*rest).alias("_row"))).alias("_m")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_m._row.*").select(*rows.columns)


def versions(ops: DataFrame, key: str) -> DataFrame:
    """Version and lineage of each template: one up for each correction."""
    return ops.groupBy(key).agg((F.count(F.lit(1)) + 1).alias("version"), F.array_sort(F.collect_list("operation_id")).alias("lineage"))


def validate_operations(ops: DataFrame) -> DataFrame:
    """Adds the fields that an operation lacks, by its type; an unknown type lacks `operation_type`."""
    lacks = F.lit(None).cast("array<string>")
    kinds = F.create_map(*[x for k, v in OPERATION_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]).cast("array<string>"))])
    need = kinds[F.col("operation_type")]
    has = F.coalesce(F.map_keys("payload"), F.array().cast("array<string>"))
    lacks = F.when(need.isNull(), F.array(F.lit("operation_type"))).otherwise(F.array_except(need, has))
    return ops.withColumn("missing", lacks)


def patch_regions(regions: DataFrame, ops: DataFrame) -> DataFrame:
    """Regions without those that a line_rejection names or a region_merge uses up."""
    gone = ops.where(F.col("operation_type").isin("line_rejection", "region_merge")).select(F.explode("target_evidence_ids").alias("region_id")).distinct()
    return regions.join(gone, "region_id", "left_anti")


def apply_corrections(fields: DataFrame, corrections: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Fields with their latest correction: label, widget and note where given, human_corrected
    set, needs_qa cleared. Of several fields at a place only the first (by field_id)."""
    texts = [c for c in ("label", "widget", "note") if c in corrections.columns]
    new = latest_wins(corrections, on, order).select(*on, *[F.col(c).alias(f"_{c}") for c in texts], F.lit(True).alias("_hit"))
    if "note" in texts and "note" not in fields.columns:
        fields = fields.withColumn("note", F.lit(None).cast("string"))
    w = Window.partitionBy(*on).orderBy("field_id")
    out = fields.withColumn("_n", F.row_number().over(w)).join(new, on, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("_n") == 1)
    given = lambda c: F.when(hit, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c))).otherwise(F.col(c))
    return out.withColumns({**{c: given(c) for c in texts}, "human_corrected": hit, "needs_qa": F.col("needs_qa") & ~hit}).drop("_n", "_hit", *[f"_{c}" for c in texts])


def approvals(fields: DataFrame, key: str) -> DataFrame:
    """Documents with their open issues; approved automatically when there are none."""
    issues = F.count_if(F.col("needs_qa") & ~F.col("human_corrected"))
    return fields.groupBy(key).agg(F.count(F.lit(1)).alias("n_fields"), issues.alias("open_issues")).withColumn("qa_status", F.when(F.col("open_issues") == 0, "approved").otherwise("pending"))


def content_hash(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row for the table, or for each part of it: the count and an order-free digest of the
    contents, to tell whether a replay gave the same result."""
    h = F.xxhash64(*columns)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("parity"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 40))), F.lit(0)).alias("total"))


def diff(expected: DataFrame, actual: DataFrame, keys: list[str], exact: list[str], near: dict[str, float]) -> DataFrame:
    """One row per difference of two tables: key, field, category, both values.
    Numbers differ beyond their tolerance; rows on one side only are structural."""
    e, a = expected.withColumn("_e", F.lit(1)), actual.withColumn("_a", F.lit(1))
    e = e.select(*keys, "_e", *[F.col(c).alias(f"e_{c}") for c in (*exact, *near)])
    a = a.select(*keys, "_a", *[F.col(c).alias(f"a_{c}") for c in (*exact, *near)])
    both = e.join(a, keys, "full")
    missing = F.col("_e").isNull() | F.col("_a").isNull()
    row = lambda field, cat, cond: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(cat).alias("category"), F.col(f"e_{field}").cast("string").alias("expected"), F.col(f"a_{field}").cast("string").alias("actual")))
    found = [row(c, "value", ~missing & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))) for c in exact]
    found += [row(c, "confidence" if "conf" in c or "score" in c else "spatial", ~missing & ((F.abs(F.col(f"e_{c}") - F.col(f"a_{c}")) > tol) | (F.col(f"e_{c}").isNull() != F.col(f"a_{c}").isNull()))) for c, tol in near.items()]
    whole = F.when(missing, F.struct(F.lit("*").alias("field"), F.lit("structural").alias("category"), F.when(F.col("_e").isNotNull(), "present").alias("expected"), F.when(F.col("_a").isNotNull(), "present").alias("actual")))
    return both.select(*keys, F.explode(F.array_compact(F.array(whole, *found))).alias("d")).select(*keys, "d.*")


def dangling(refs: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """References to ids that don't exist."""
    return refs.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)), column, "left_anti")


def write_once(existing: DataFrame, new: DataFrame, key: str = "artifact_id") -> DataFrame:
    """The rows of `new` that a content-addressed store lacks, each id once."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours and degrees of a typed graph's nodes."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "edge_type")
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "edge_type")
    return out.union(back).groupBy("node").agg(F.countDistinct("other").alias("degree"), F.sort_array(F.collect_set("edge_type")).alias("types"))


# Seconds that the jobs of a queue may take.
QUEUES = {"ingestion": 600, "analytics": 120}


def job_status(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Where each job (job_id, queue) stands by its events (job_id, event, at: started, finished
    or failed): queued, started, finished or failed; failed as well when it took longer than
    its queue allows."""
    times = events.groupBy("job_id").agg(*[F.min(F.when(F.col("event") == e, F.col("at"))).alias(e) for e in ("started", "finished", "failed")])
    most = F.create_map(*[F.lit(x) for kv in QUEUES.items() for x in kv])[F.col("queue")]
    late = F.timestamp_diff("MICROSECOND", F.col("started"), F.coalesce(F.least("finished", "failed"), now)) > most * 1_000_000
    status = F.when(F.col("failed").isNotNull() | late, "failed").when(F.col("finished").isNotNull(), "finished").when(F.col("started").isNotNull(), "started").otherwise("queued")
    return jobs.join(times, "job_id", "left").withColumn("status", status)


def dead_letters(rows: DataFrame, failed: Column, at: str, attempts: str = "attempts") -> tuple[DataFrame, DataFrame]:
    """The rows that went well, and the failed ones with the time of their next try."""
    from ..functions.text import retry_at

    bad = rows.where(failed).withColumn("retry_at", retry_at(F.col(at), F.col(attempts)))
    return rows.where(~failed), bad.withColumn("exhausted", F.col("retry_at").isNull())
