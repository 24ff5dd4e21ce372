"""Structured Streaming: ledger, lifecycle, windows, files, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import HUMAN_STATES, TRANSITIONS


def ledger(ops: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Operations with duplicate ids dropped, for as long as the watermark keeps them."""
    return ops.withWatermark(at, late).dropDuplicatesWithinWatermark(["operation_id"])


_CHANGES = "key string, seq long, from_state string, to_state string, actor string, legal boolean, needs_human boolean"


def lifecycle(changes: DataFrame) -> DataFrame:
    """Each change of state (key, seq, to_state, actor) with its legality, in order of
    seq within a batch. An illegal change doesn't move the state and is marked, so
    that it can go to a side output; nothing stops the stream."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, to, actor in zip(rows["seq"], rows["to_state"], rows["actor"], strict=True):
            legal = to == "INGESTED" if now is None else to in TRANSITIONS.get(now, ())
            human = to in HUMAN_STATES and not str(actor or "").startswith("user:")
            out.append((key[0], seq, now, to, actor, legal, human))
            now = to if legal else now
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGES.split(", ")])

    return changes.groupBy("key").applyInPandasWithState(step, _CHANGES, "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type; events later than the watermark are left out."""
    per = events.withWatermark(at, late).groupBy(F.window(at, every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, at: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    per = events.withWatermark(at, late).groupBy(F.session_window(at, gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("started"), "n")


def template_versions(ops: DataFrame) -> DataFrame:
    """Version of each template, for update mode."""
    return ops.groupBy("template_id").agg((F.count(F.lit(1)) + 1).alias("version"))


def new_files(spark: SparkSession, root: str, archive: str | None = None) -> DataFrame:
    """Files as they come below a root; moved to an archive folder once done, if one is given."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.schema("path string, modificationTime timestamp, length long, content binary").load(root)


def with_dead_letters(stream: DataFrame, good: Callable[[DataFrame], None], dead: str, error: str = "error", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over what is there: rows without an error go to `good`, the others
    are appended to a table of dead letters with their batch. The batch number keeps
    a repeated batch from being written twice."""

    def each(batch: DataFrame, number: int) -> None:
        batch.where(F.col(error).isNotNull()).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        good(batch.where(F.col(error).isNull()))

    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
