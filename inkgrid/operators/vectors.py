"""Nearest vectors of a query set: matrix products of blocks, with partial results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", places: int = 5) -> DataFrame:
    """The k nearest rows of each query by cosine (rounded to some places; ties to the smaller
    key), the query itself left out: q, key, c.

    Queries are dealt into blocks of about BLOCK, and the vectors into one chunk for each shuffle
    partition; each chunk meets each block in a task that holds the block and takes the chunk's
    vectors as they stream in. A task gives its best k of each query, and these are ranked."""
    spark = vectors.sparkSession
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    rows = lambda df, kind: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(kind).alias("kind"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows(queries, 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("chunk", every(chunks))
    given = rows(vectors, 1).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)).cast("int")).withColumn("block", every(n_blocks))
    dealt = asked.unionByName(given).repartition(chunks, "chunk", "block").sortWithinPartitions("chunk", "block", "kind").select("chunk", "block", "kind", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, qs, ids, best = None, [], [], None

        def close() -> Iterator[pa.RecordBatch]:
            for q, found in zip(ids, best or (), strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found)), pa.array([i for _, i in found], pa.int64()), pa.array([-c for c, _ in found], pa.float64())], names=["q", key, "c"])

        for b in batches:
            group = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            edges = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                chunk, block, kind = group[lo]
                if (chunk, block) != now:
                    yield from close()
                    now, qs, ids, best = (chunk, block), [], [], None
                part = b.slice(lo, hi - lo)
                v = np.array(part.column(4).to_pylist(), np.float64)
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                own = part.column(3).to_pylist()
                if kind == 0:
                    qs.append(v)
                    ids += own
                    continue
                if not ids:
                    continue
                qs = [np.concatenate(qs)] if len(qs) > 1 else qs
                best = best or [[] for _ in ids]
                cosine = np.round(qs[0] @ v.T, places)
                take = min(k + 1, len(own))
                top = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
                for i, q in enumerate(ids):
                    low = cosine[i, top[i]].min()
                    near = top[i] if (cosine[i] == low).sum() <= (cosine[i, top[i]] == low).sum() else np.flatnonzero(cosine[i] >= low)
                    best[i] = sorted(best[i] + [(-float(cosine[i, j]), own[j]) for j in near.tolist() if own[j] != q])[:k]
        yield from close()

    found = dealt.mapInArrow(run, f"q long, {key} long, c double")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("c").desc(), key))).where(F.col("_n") <= k).drop("_n")
