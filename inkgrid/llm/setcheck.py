"""Exact intersection sizes of pairs of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Pairs that are compared at one place, about.
MEET = 4096
_CHECKED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])


def common_items(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, common, total) of pairs (u, v) of classes, on full sets (cls, items: sorted).

    The sets of v are sent to the place of u's; the sets by class are shuffled once for both
    sides. Both are plain equi-joins, so a u of very many pairs is split by Spark."""
    members = pairs.join(sets.select(F.col("cls").alias("v"), F.col("items").alias("own")), "v")
    both = members.join(sets.select(F.col("cls").alias("u"), F.col("items").alias("lead")), "u").select("u", "v", "own", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                small, large = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(small) > len(large):
                    small, large = large, small
                at = large.searchsorted(small)
                at[at == len(large)] = 0
                common[i] = n = np.count_nonzero(large[at] == small)
                total[i] = len(small) + len(large) - n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common), pa.array(total)], schema=_CHECKED)

    return both.mapInArrow(run, "u long, v long, common long, total long")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many items two sets (sorted) have in common."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = large.searchsorted(small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


def dealt_pairs(pairs: DataFrame) -> DataFrame:
    """(u, v, g, chunk): pairs (u < v) with the place where they are compared. Pairs of classes
    that all look alike meet at the least of them, so that a set is sent there once for all its
    pairs; places of many pairs are split by v."""
    least = pairs.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("least"))
    own = pairs.join(least, "u", "left").select("u", "v", F.coalesce("least", "u").alias("g"))
    count = own.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("n"))
    return own.join(count, "g").select("u", "v", "g", F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("chunk"))


def needed_sets(dealt: DataFrame) -> DataFrame:
    """(cls, g, chunk): the classes whose sets are needed at each place."""
    return dealt.select(F.explode(F.array("u", "v")).alias("cls"), "g", "chunk").distinct()


def common_at_places(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, common, total) of dealt pairs, on full sets (cls, g, chunk, items: sorted) of all needed classes."""
    place = ("g", "chunk")
    null = F.lit(None)
    rows = sets.select(*place, F.lit(0).alias("kind"), F.col("cls").alias("u"), null.cast("long").alias("v"), "items")
    rows = rows.unionByName(dealt.select(*place, F.lit(1).alias("kind"), "u", "v", null.cast("binary").alias("items")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}
        for b in batches:
            out = []
            for g, chunk, kind, u, v, items in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5), strict=True):
                if (g, chunk) != now:
                    now, own = (g, chunk), {}
                if kind == 0:
                    own[u] = np.frombuffer(items.as_buffer(), np.uint64).copy()
                else:
                    n = _shared(own[u], own[v])
                    out.append((u, v, n, len(own[u]) + len(own[v]) - n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_CHECKED)

    rows = rows.repartition(partitions(dealt.sparkSession), *place).sortWithinPartitions(*place, "kind")
    return rows.mapInArrow(run, "u long, v long, common long, total long")


def common_matrix(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, by products of 0/1
    matrices over the items that more than one set has, some columns at a time."""
    sets = [*left, *right]
    items, where = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(where, minlength=len(items))
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[where]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int((times > 1).sum()), columns):
        a, b = np.searchsorted(column, [low, low + columns])
        grid = np.zeros((len(sets), columns), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out.astype(np.int64)
