"""Rendezvous sharding of stable record keys over weighted shards (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions


def _score(key_hash: Column, shard: int, weight: float) -> Column:
    """Exponential race: -ln(u) / weight with u uniform in (0, 1) from key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key_hash, F.lit(shard)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least score. Only the key and the weights decide, so
    a further shard takes keys only into itself, in proportion to its weight.
    A null key is a key of its own. Equal scores go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    h = F.xxhash64(key.cast("string"))
    return F.array_min(F.array(*[F.struct(_score(h, j, w).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights)]))["j"]


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, blocks: int | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's documents from 0. Rows get a number of their own when
    they are written, which deals them into blocks: each (shard, block) is numbered on
    its own and begins at the count of the blocks before it. So no task holds a whole
    shard, nor all rows of a key that many rows share.
    ``grown_shard`` is the shard with one more shard of ``grown_weight``.

    Null text: size 1, crc 0. Equal rows each get a row and a slot. An empty
    table gives an empty result. Other columns are not read."""
    n = blocks or max(64, partitions(docs.sparkSession))
    k, body = docs[key], F.coalesce(docs[text].cast("string"), F.lit(""))
    placed = docs.select(
        k.alias("key"), rendezvous(k, weights).alias("shard"), rendezvous(k, [*weights, grown_weight]).alias("grown_shard"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("number"),
    )
    rows = Workspace(docs.sparkSession, "shards").write(placed, "placed").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("number")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["shard", "block"])
    slot = (F.col("start") + F.col("rank")).cast("long").alias("slot")
    return ranked.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), slot, F.col("grown_shard").cast("int"))
