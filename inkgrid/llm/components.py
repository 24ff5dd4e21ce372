"""Connected components of links in tables: union-find in tasks, stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class UnionFind:
    """Sets of numbers; the least one of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars about the least member."""
    sets = UnionFind()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.join(u, v)
    pairs = [(x, sets.root(x)) for x in list(sets.up)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=_PAIRS)


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(u, v): v is the least member of u's component, for each u that is not it.

    `links` has the columns u and v. Each task first contracts its own links by
    union-find; then the large-star and small-star steps alternate until nothing
    changes. The stars meet by joins, so a member with very many links is no
    group of one task. Each step's table is written, and the one before goes."""
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = space.write(links.mapInArrow(_contract, "u long, v long").distinct(), f"{name}-0")
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    k, was = 0, state(edges)
    while was[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        edges = space.write(small, f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges
