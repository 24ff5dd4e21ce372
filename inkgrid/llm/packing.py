"""Best-fit packing of token pieces, after Martello-Toth dominance reduction.

A piece is described by its length alone, and there are at most `capacity`
lengths. So the instance is the histogram of lengths, whatever the corpus: the
plan is made from it on the driver, by counts, and says which ranks of each
length go to which sequences. The pieces then find their places by rank."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .encoding import encoder
from .words import pieces_by_bytes

CAPACITY = 2048
END_ID = 0


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest length with pieces left, of at most `most`; 0 if there is none."""
    at = np.flatnonzero(counts[1 : most + 1])
    return int(at[-1]) + 1 if len(at) else 0


def _smallest_sum(counts: np.ndarray, own: int, k: int) -> int | None:
    """The sum of the k smallest lengths left beside one piece of length own."""
    total = 0
    for w in np.flatnonzero(counts).tolist():
        free = int(counts[w]) - (w == own)
        take = min(k, free)
        total += take * w
        k -= take
        if not k:
            return total
    return None


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes bins that some optimal packing has, and takes their pieces out of
    `counts` (pieces by length). Returns (lengths, number of such bins).

    For the longest piece w left in turn, the sets that could stand beside it
    hold at most k pieces, k from the smallest ones. If none fits, w stands
    alone. If one at most fits, or w and the largest that fits fill the bin,
    that pair dominates all others. If two at most fit and the largest that
    fits is no shorter than the best two together, the pair dominates as well;
    and if the best two fill the bin and no single piece comes near, each set
    is smaller than theirs piece by piece when they are also the largest that
    fit: then the triple dominates. Steps are repeated over all equal pieces."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    for w in range(capacity, 0, -1):
        while counts[w]:
            room = capacity - w
            counts[w] -= 1
            best = _largest(counts, room) if room else 0
            counts[w] += 1
            if not best:
                fixed.append(((w,), int(counts[w])))
                counts[w] = 0
                continue
            two = _smallest_sum(counts, w, 2)
            three = _smallest_sum(counts, w, 3)
            pair = w + best == capacity or two is None or two > room
            if not pair and (three is None or three > room):
                a, b = _best_two(counts, w, room)
                pair = best >= a + b
                if not pair and a == best and a + b == room and b == _largest_beside(counts, w, a, room - a) == _largest_beside(counts, w, a, best):
                    n = _times((w, a, b), counts)
                    fixed.append(((w, a, b), n))
                    for x in (w, a, b):
                        counts[x] -= n
                    continue
            if not pair:
                break
            # The bound on the other sets rests on the smallest pieces left, which only grow.
            n = _times((w, best), counts)
            fixed.append(((w, best), n))
            counts[w] -= n
            counts[best] -= n
    return fixed


def _times(bin_: tuple[int, ...], counts: np.ndarray) -> int:
    return min(int(counts[x]) // bin_.count(x) for x in bin_)


def _largest_beside(counts: np.ndarray, w: int, a: int, most: int) -> int:
    left = counts.copy()
    left[w] -= 1
    left[a] -= 1
    return _largest(left, most) if most > 0 else 0


def _best_two(counts: np.ndarray, w: int, room: int) -> tuple[int, int]:
    """Two pieces of the largest sum within room, the longer first; (0, 0) if none."""
    left = counts.copy()
    left[w] -= 1
    best = (0, 0)
    for a in np.flatnonzero(left[: room + 1])[::-1].tolist():
        if 2 * a <= sum(best):
            break
        left[a] -= 1
        b = _largest(left, min(a, room - a)) if room > a else 0
        left[a] += 1
        if b and a + b > sum(best):
            best = (a, b)
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing by counts: (runs of (length, times), number of bins).

    Open bins are kept by free room, in groups of bins with equal contents. All
    pieces of a length go, at once, each time into the fullest bins they fit in;
    as a further piece of that length then goes into the same bin if it fits,
    a bin takes as many as it can."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    full: list[tuple[list[tuple[int, int]], int]] = []

    def put(room: int, runs: tuple[tuple[int, int], ...], n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((runs, n))
        elif n:
            full.append((list(runs), n))

    for w in range(capacity, 0, -1):
        left = int(counts[w])
        for room in sorted(r for r in open_ if r >= w):
            each = room // w
            groups = open_.pop(room)
            while groups and left:
                runs, n = groups.pop()
                whole = min(n, left // each)
                put(room - each * w, (*runs, (w, each)), whole)
                left -= whole * each
                if whole < n and left:
                    put(room - left * w, (*runs, (w, left)), 1)
                    whole, left = whole + 1, 0
                if whole < n:
                    groups.append((runs, n - whole))
            for g in groups:
                put(room, *g)
            if not left:
                break
        each = capacity // w
        put(capacity - each * w, ((w, each),), left // each)
        if left % each:
            put(capacity - left % each * w, ((w, left % each),), 1)
    return full + [(list(runs), n) for groups in open_.values() for runs, n in groups]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, run, sequence, offset), by length and rank:
    rank r of a length goes to sequence + (r - first) // run, at offset plus
    (r - first) % run lengths. One row for each run of each kind of bin."""
    counts = np.zeros(capacity + 1, np.int64)
    for w, n in histogram.items():
        counts[w] = n
    bins: list[tuple[list[tuple[int, int]], int]] = [([(w, 1) for w in b], n) for b, n in reduce_dominated(counts, capacity)]
    bins += best_fit(counts, capacity)
    given = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for runs, n in bins:
        at = 0
        for w, times in runs:
            rows.append((w, int(given[w]), n * times, times, sequence, at))
            given[w] += n * times
            at += w * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each text's ids with END_ID, in pieces of at most `capacity`: doc_id, piece,
    start, length, ids_crc32 and, if kept, ids (little-endian 32-bit). Only longer
    documents are cut; then the first piece is the short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in (p for whole in batches for p in pieces_by_bytes(whole, 1)):
            out = []
            for d, got in zip(batch.column(0).to_pylist(), enc.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(got, np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                for p, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : (first if p == 0 else start + capacity)]
                    out.append((d, p, start, len(part), zlib.crc32(part), part.tobytes() if keep_ids else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all pieces into sequences: the columns of cut_pieces, sequence_id and offset.

    The driver holds the histogram of lengths (at most `capacity` rows) and the
    plan made from it (one row for each run of a kind of bin). A piece's rank
    among those of its length comes from blocks of the number that it gets when the
    pieces are written: each (length, block) is numbered on its own and begins at the
    count of the blocks before it, so a length, a document or a row that a third of the
    pieces have is spread over all blocks.

    Null or empty text: one piece of END_ID alone. Equal rows are packed one by
    one. An empty table gives an empty result. Other columns are not read."""
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    pieces = space.write(cut_pieces(docs, tokenizer, capacity, key, text, keep_ids).withColumn("_n", F.monotonically_increasing_id()), "pieces")
    n = max(64, partitions(spark))
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(n)).cast("int"))
    counts = space.write(blocked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths, first, _, run, sequence, offset = plan(histogram, capacity).T if histogram else np.zeros((6, 0), np.int64)
    # Ranks of a length never reach `wide`, so (length, rank) is one number.
    wide = max(histogram.values(), default=0) + 1
    starts = lengths * wide + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        w, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.searchsorted(starts, w * wide + r, "right") - 1
        k = r - first[row]
        return pd.DataFrame({"sequence_id": sequence[row] + k // run[row], "offset": offset[row] + k % run[row] * w})

    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("length", "_block").orderBy("_n")
    ranked = blocked.withColumn("_rank", F.row_number().over(inside) - 1).join(begins, ["length", "_block"])
    placed = ranked.withColumn("_at", place("length", F.col("_begin") + F.col("_rank")))
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return placed.select(*own, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
