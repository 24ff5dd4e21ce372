"""Line dedup: an exact set-similarity join of lines; later matches go."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, Workspace, partitions
from .components import components
from .setcheck import common_at_places, common_matrix, dealt_pairs, needed_sets
from .sketch import KeyFilter, bits_for, slot_levels, slot_of
from .words import _GOLD, Words, column_words, mix, pieces_by_bytes, raw_texts, words_of

#: Classes that a prefix token may have to be compared with each other at once; keys of more are hot.
GROUP = 512
#: Postings that are compared at once.
ROWS = 1 << 16
#: Classes of a family on one side of a comparison.
SIDE = 256
#: Sets over so many tokens have a wide parity map of so many bits; wider ones fold to narrower ones.
WIDE = ((48, 256), (256, 1024))
#: Bytes of text for a slot of the token table.
SLOT_BYTES = 32


def token_levels(texts: DataFrame) -> np.ndarray:
    """How often the tokens of each slot occur in all texts, as sketch.level_of.

    The number of slots follows the size of the input, up to 64 MB of them. A slot's
    level is at least that of each of its tokens; so with a level of 1 the token is nowhere else."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = bits_for(size / SLOT_BYTES if size < 1 << 60 else 1 << 22)  # beyond: Spark doesn't know it

    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for b in pieces_by_bytes(batch, 0):
            yield slot_of(column_words(b.column(0)).hashes, bits)

    return slot_levels(texts, slots, bits)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least common tokens of a set of n with any set it is linked to."""
    return -(-percent * n // 100)


_LINES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("line_no", pa.int32()), ("n_tokens", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64()), ("parity", pa.int64()), ("skip", pa.int32()), ("prefix", pa.list_(pa.int32())), ("wide", pa.binary())])
#: Where a line is: rows that share a doc_id, or have none, are told apart by their texts.
PLACE = ("doc_id", "row_key", "line_no")
_LINES_SQL = "doc_id long, row_key long, line_no int, n_tokens int, s0 long, s1 long, parity long, skip int, prefix array<int>, wide binary"


def _lines_of(raw: np.ndarray, at: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its line, counted over all texts; and of each text its first line and number of lines."""
    ends = np.flatnonzero(raw == 10)
    before = np.searchsorted(ends, at)  # line ends before each text
    texts = np.arange(len(at) - 1)
    line = np.searchsorted(ends, w.begins) + np.repeat(texts, np.diff(w.firsts))
    return line, before[:-1] + texts, np.diff(before) + 1


def _by_rarity(h: np.ndarray, line: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The order by (line, level, token) without repeats of a token in a line. One sort
    over the top bits of all three; if two tokens have those in common, over all of them."""
    if not len(h):
        return np.zeros(0, np.int64)
    line = line - line[0]
    bits = max(int(line[-1]).bit_length(), 1)
    sure = 56 - bits
    key = line.astype(np.uint64) << np.uint64(64 - bits) | level.astype(np.uint64) << np.uint64(sure) | h >> np.uint64(64 - sure)
    order = np.argsort(key)
    key, own = key[order], h[order]
    same = key[1:] == key[:-1]
    if (own[1:][same] != own[:-1][same]).any():
        order = np.lexsort((h, level, line))
        same = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
    return order[np.concatenate([[True], ~same])]


def wide_maps(h: np.ndarray, n: np.ndarray, at_once: int = 1 << 8) -> pa.Array:
    """The wide parity maps of sets of n tokens that lie one after another; null for short sets."""
    begins = np.cumsum(n) - n
    size = np.zeros(len(n), np.int64)
    for low, bits in WIDE:
        size[n > low] = bits // 8
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    for bits in (bits for _, bits in WIDE):
        of = np.flatnonzero(size == bits // 8)
        for k in range(0, len(of), at_once):
            some = of[k : k + at_once]
            own = np.repeat(np.arange(len(some)), n[some])
            tokens = h[np.arange(len(own)) + np.repeat(begins[some] - (np.cumsum(n[some]) - n[some]), n[some])]
            odd = np.bincount(own * bits + (tokens >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=len(some) * bits).astype(np.uint8) & 1
            out[(ends - size)[some][:, None] + np.arange(bits // 8)] = np.packbits(odd.reshape(len(some), bits), axis=1)
    places = np.concatenate([[0], ends]).astype(np.int32)
    known = np.packbits(size > 0, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [pa.py_buffer(x) for x in (known, places, out)])


def _apart(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) without those of one family, which are compared in blocks, and those that the wide parity maps
    of both show to have too many different tokens. facts: cls, fam, n_tokens, wide."""
    side = lambda c: facts.select(F.col("cls").alias(c), F.col("fam").alias(f"fam_{c}"), F.col("n_tokens").alias(f"n_{c}"), F.col("wide").alias(f"w_{c}"))
    both = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").where("fam_u is null or fam_v is null or fam_u <> fam_v")
    both = both.select("u", "v", "n_u", "n_v", "w_u", "w_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = np.ones(b.num_rows, bool)
            sizes = [b.column(c).fill_null(0).to_numpy().astype(np.int64) for c in (2, 3)]
            maps = [raw_texts(b.column(c)) for c in (4, 5)]
            long = [np.diff(at) for _, at in maps]
            for x in np.unique(long[0][long[0] > 0]).tolist():
                for y in np.unique(long[1][long[1] > 0]).tolist():
                    rows = np.flatnonzero((long[0] == x) & (long[1] == y))
                    if not len(rows):
                        continue
                    w = min(x, y)
                    u, v = (np.bitwise_xor.reduce(raw[at[rows][:, None] + np.arange(k)].reshape(len(rows), k // w, w), axis=1) for (raw, at), k in zip(maps, (x, y), strict=True))
                    n = sizes[0][rows] + sizes[1][rows]
                    common = (percent * n + 99 + percent) // (100 + percent)
                    on[rows] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64) <= n - 2 * common
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(on)) for c in (0, 1)], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id, or of none, apart; the same whenever it is computed."""
    return F.xxhash64(text.cast("string"))


def line_sets(texts: DataFrame, levels: np.ndarray, percent: int, least: int) -> DataFrame:
    """A row for each line of at least `least` distinct tokens: its place, set size,
    a 128-bit digest (s0, s1) and a 64-bit parity map of the set, and its prefix: the
    rarest tokens, of which any linked set has one, by 32 bits of their hashes. The
    first `skip` of them are left out, as they occur nowhere else; sets too small to be
    linked with another set have none; and of larger sets a wide parity map."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)  # 64 MB at most
    bits = len(levels).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_by_bytes(batch, 1, 1 << 18):
                yield sets_of(b)

    def sets_of(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = raw_texts(b.column(1))
        w = words_of(raw, at)
        line, first, n_lines = _lines_of(raw, at, w)
        level = shared.value[slot_of(w.hashes, bits)]
        order = _by_rarity(w.hashes, line, level)
        h, line, level = w.hashes[order], line[order], level[order]
        n = np.bincount(line, minlength=int(n_lines.sum()))
        on = n[line] >= least
        h, line, level = h[on], line[on], level[on]
        lines = np.flatnonzero(n >= max(least, 1))
        if not len(lines):
            return pa.RecordBatch.from_pylist([], schema=_LINES)
        owner = np.searchsorted(first, lines, "right") - 1
        n = n[lines]
        begins = np.cumsum(n) - n
        s0, s1 = np.add.reduceat(mix(h + _GOLD), begins), np.add.reduceat(mix(mix(h) ^ _GOLD), begins)
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), begins)
        place = np.arange(len(h)) - np.repeat(begins, n)
        length = np.where(100 * n >= percent * (n + 1), n - needed(n, percent) + 1, 0)
        taken = (place < np.repeat(length, n)) & (level > 1)
        skip = np.add.reduceat((level <= 1).astype(np.int32), begins).astype(np.int32)
        ends = np.cumsum(np.add.reduceat(taken.astype(np.int32), begins))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array((h[taken] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        own = [b.column(c).take(pa.array(owner)) for c in (0, 2)]
        rest = [(lines - first[owner]).astype(np.int32), n.astype(np.int32), s0.view(np.int64), s1.view(np.int64), parity.view(np.int64), skip]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, rest), lists, wide_maps(h, n)], schema=_LINES)

    return texts.mapInArrow(run, _LINES_SQL)


def _place_hash(doc_id: np.ndarray, row_key: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.view(np.uint64) + _GOLD) + row_key.view(np.uint64)) + line_no.astype(np.uint64)


def _class_sets(docs: DataFrame, asked: DataFrame, needed: DataFrame, space: Workspace) -> DataFrame:
    """(cls, g, chunk, items): the token sets of asked classes (cls and the place of the first
    line), for each place (g, chunk) of `needed`. Texts are read where they are: lines whose places
    pass a filter of the asked ones give their sets, which then meet the places; so no text is shuffled."""
    doc = F.coalesce("doc_id", F.lit(0))  # rows without doc_id have row_key

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _place_hash(*(b.column(c).to_numpy() for c in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    keys = space.write(asked.select(doc.alias("doc_id"), "row_key", "line_no").mapInArrow(hashes, "h long"), "asked")
    known = docs.sparkSession.sparkContext.broadcast(KeyFilter(keys, keys.count()))
    space.drop("asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_by_bytes(batch, 1):
                yield sets_of(b)

    def sets_of(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = raw_texts(b.column(1))
        ends = np.flatnonzero(raw == 10)
        before = np.searchsorted(ends, at)
        n_lines = np.diff(before) + 1
        own = np.repeat(np.arange(len(n_lines)), n_lines)
        begins, stops = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        first = np.cumsum(n_lines) - n_lines
        inner = np.ones(len(own), bool)
        inner[first] = False
        begins[inner], begins[first] = ends + 1, at[:-1]
        inner[:] = True
        inner[first + n_lines - 1] = False
        stops[inner], stops[first + n_lines - 1] = ends, at[1:]
        number = np.arange(len(own)) - first[own]
        doc_id, key = (b.column(c).to_numpy() for c in (0, 2))
        where = _place_hash(doc_id[own], key[own], number)
        on = np.flatnonzero(known.value(where))
        on = on[np.unique(where[on], return_index=True)[1]]
        sizes = stops[on] - begins[on]
        places = np.concatenate([[0], np.cumsum(sizes)])
        part = raw[np.repeat(begins[on] - places[:-1], sizes) + np.arange(places[-1])] if len(on) else raw[:0]
        w = words_of(part, places)
        sets = [np.unique(w.hashes[i:k]) for i, k in zip(w.firsts[:-1].tolist(), w.firsts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_id[own[on]]), pa.array(key[own[on]]), pa.array(number[on].astype(np.int32)), pa.array([x.tobytes() for x in sets], pa.binary())],
            names=["doc_id", "row_key", "line_no", "items"],
        )

    found = docs.select(doc.alias("doc_id"), "text", "row_key").mapInArrow(run, "doc_id long, row_key long, line_no int, items binary")
    wanted = asked.select(doc.alias("doc_id"), "row_key", "line_no", "cls").join(needed, "cls")
    # Rows equal in doc_id and text are one row; the join has put their lines together.
    place = ["doc_id", "row_key", "line_no"]
    return found.join(wanted, place).dropDuplicates([*place, "cls", "g", "chunk"]).select("cls", "g", "chunk", "items")


def _cold_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Of postings (key, cls, np, parity): candidates (u, v) of keys of at most GROUP
    classes; and the postings of hot keys as they are, with u null. np holds the set
    size and the place of the token, in 32 bits each.

    A set is found by its shorter prefix from the longer prefix of sets no smaller. The
    length filter, the positional filter and the parity maps (which bound the difference
    of two sets from below) follow. Groups of a key are compared by shifts of whole arrays."""

    def pairs(key: np.ndarray, cls: np.ndarray, np_: np.ndarray, parity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, at, parity = np_ >> 32, np_ & 0xFFFFFFFF, parity.view(np.uint64)
        us, vs = [], []
        # By (key, size, place): a row meets the later ones of its key, until they are too large for it.
        i = np.flatnonzero(at < n - (2 * percent * n + 99 + percent) // (100 + percent) + 1)
        k = 1
        while len(i := i[: np.searchsorted(i, len(key) - k)]):
            j = i + k
            on = (key[i] == key[j]) & (n[i] * 100 >= n[j] * percent)
            i, j = i[on], j[on]
            common = (percent * (n[i] + n[j]) + 99 + percent) // (100 + percent)
            ok = (np.minimum(n[i] - at[i], n[j] - at[j]) >= common) & (np.bitwise_count(parity[i] ^ parity[j]) <= n[i] + n[j] - 2 * common) & (cls[i] != cls[j])
            us.append(cls[i[ok]])
            vs.append(cls[j[ok]])
            k += 1
        u, v = (np.concatenate(us), np.concatenate(vs)) if us else (cls[:0], cls[:0])
        return np.minimum(u, v), np.maximum(u, v)

    def send(u: np.ndarray, v: np.ndarray, hot: list[np.ndarray]) -> pa.RecordBatch:
        n, m = len(u), len(hot[0])
        both = [pa.array(np.concatenate([u, hot[1]])), pa.array(np.concatenate([v, hot[1]]))]
        rest = [pa.array(np.concatenate([np.zeros(n, x.dtype), x])) for x in (hot[0], *hot[2:])]
        return pa.RecordBatch.from_arrays([*both, *rest, pa.array(np.arange(n + m) >= n)], names=_MET.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, hot_key = [], 0, None
        for b in batches:
            if b.num_rows:
                parts.append([c.to_numpy() for c in b.columns])
                size += b.num_rows
            if size >= ROWS:
                out, held, hot_key = split([np.concatenate(x) for x in zip(*parts, strict=True)], hot_key)
                parts, size = [held] if held else [], 0
                if out is not None:
                    yield out
        if parts:
            yield split([np.concatenate(x) for x in zip(*parts, strict=True)], hot_key, True)[0]

    def split(rows: list[np.ndarray], hot_key: int | None, last: bool = False) -> tuple[pa.RecordBatch | None, list[np.ndarray] | None, int | None]:
        """What is settled, the rows of the last key if they may go on, and that key if it is hot already."""
        order = np.lexsort((rows[2], rows[0]))
        rows = [x[order] for x in rows]
        key = rows[0]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        hot = size > GROUP
        hot[0] |= hot_key is not None and key[0] == hot_key
        hold = not last and not hot[-1]
        done = edge[-1] if hold else len(key)
        is_hot = np.repeat(hot, size)[:done]
        on = [x[:done][~is_hot] for x in rows]
        out = send(*pairs(*on), [x[:done][is_hot] for x in rows]) if done else None
        return out, [x[done:] for x in rows] if hold else None, int(key[-1]) if hot[-1] else None

    rows = postings.repartition(partitions(postings.sparkSession), "key").sortWithinPartitions("key")  # one column: a radix sort
    return rows.select("key", "cls", "np", "parity").mapInArrow(run, "u long, v long, key int, np long, parity long, hot boolean")


_MET = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int32()), ("np", pa.int64()), ("parity", pa.int64()), ("hot", pa.bool_())])


def _hot_pairs(hot: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, v) of hot keys, of different families, by a join of the shorter
    with the longer prefixes. Keys hold the token and the size in steps of
    100 / percent, so that only sizes within a step meet."""
    rows = hot.join(families, "cls", "left").select("key", "cls", "np", "parity", F.coalesce("fam", "cls").alias("fam"))
    size = F.shiftright("np", 32)
    step = F.floor(F.log(size) / math.log(100 / percent) + 1e-9).cast("long") if percent < 100 else size
    dealt = lambda s: (F.col("key").cast("long") * 256 + s).alias("key")
    short = F.expr(f"(np >> 32) - ({2 * percent}L * (np >> 32) + {99 + percent}) div {100 + percent} + 1")
    own = ("cls", "fam", "np", "parity")
    x = rows.where(F.col("np").bitwiseAND(0xFFFFFFFF) < short).select(F.explode(F.array(step, step + 1)).alias("step"), "key", *own).select(dealt(F.col("step")), *own).alias("x")
    y = rows.select(dealt(step), *own).alias("y")
    n = lambda side: F.shiftright(F.col(f"{side}.np"), 32)
    at = lambda side: F.col(f"{side}.np").bitwiseAND(0xFFFFFFFF)
    common = F.expr(f"({percent} * ((x.np >> 32) + (y.np >> 32)) + {99 + percent}) div {100 + percent}")
    on = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.fam") != F.col("y.fam"))
        & ((n("x") < n("y")) | (n("x") == n("y")) & (F.col("x.cls") < F.col("y.cls")))
        & (n("x") * 100 >= n("y") * percent)
        & (F.least(n("x") - at("x"), n("y") - at("y")) >= common)
        & (F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity"))) <= n("x") + n("y") - 2 * common)
    )
    return x.join(y, on).select(F.least("x.cls", "y.cls").alias("u"), F.greatest("x.cls", "y.cls").alias("v"))


def _families(hot: DataFrame, space: Workspace) -> DataFrame:
    """(cls, fam): groups of classes that look alike, of those with two hot tokens or more: by
    the two least hashes of these, and half of the shorter list of them in common. Families
    only say how pairs are compared: those within one in blocks, all others by joins."""
    own = space.write(hot.groupBy("cls").agg(F.collect_set("key").alias("tokens")).where(F.size("tokens") > 1), "hot-tokens")
    two = lambda seed: F.slice(F.array_sort(F.transform("tokens", lambda t: F.xxhash64(F.lit(seed), t))), 1, 2)
    keyed = own.select("cls", F.explode(F.array(*[F.xxhash64(F.lit(seed), two(seed)) for seed in range(4)])).alias("h"))
    leads = keyed.groupBy("h").agg(F.min("cls").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = keyed.join(leads.select("h", "u"), "h").where("u <> cls").select("u", F.col("cls").alias("v")).distinct()
    side = lambda c, p: own.select(F.col("cls").alias(c), F.col("tokens").alias(p))
    alike = pairs.join(side("u", "pu"), "u").join(side("v", "pv"), "v").where(2 * F.size(F.array_intersect("pu", "pv")) >= F.least(F.size("pu"), F.size("pv"))).select("u", "v")
    stars = components(alike, space, "families")
    return stars.select(F.col("u").alias("cls"), F.col("v").alias("fam")).union(stars.select(F.col("v").alias("cls"), F.col("v").alias("fam")).distinct())


_COUNTED = pa.schema([("cls", pa.int64()), ("n_links", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("line_no", pa.int32())])


def _family_counts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each class of a family (cls, fam, place) its number of links with others of
    the family and the earliest place of these, in parts: a row per block of two
    chunks of the family. A class is sent to as many blocks as there are chunks."""
    size = members.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("n"))
    rows = members.join(size, "fam").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("n")))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    block = F.transform(other, lambda k: F.struct(F.least(k, F.col("chunk")).alias("a"), F.greatest(k, F.col("chunk")).alias("b")))
    dealt = rows.select("fam", "cls", "chunk", *[f"place.{c}" for c in PLACE], F.explode(block).alias("k")).select("fam", "k.a", "k.b", "chunk", "cls", *PLACE)
    dealt = sets.join(dealt, "cls").select("fam", "a", "b", "chunk", "cls", *PLACE, "items")

    def compare(sides: list[list[tuple]], same: bool) -> list[tuple]:
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right:
            return []
        n = [np.array([len(x[4]) for x in side]) for side in (left, right)]
        common = common_matrix([x[4] for x in left], [x[4] for x in right])
        link = 100 * common >= percent * (n[0][:, None] + n[1][None, :] - common)
        if same:
            np.fill_diagonal(link, False)
        out = []
        for side, others, on in ((left, right, link), (right, left, link.T))[: 1 if same else 2]:
            order = sorted(range(len(others)), key=lambda i: (others[i][1] is not None, others[i][1] or 0, *others[i][2:4]))
            on = on[:, order]
            first = on.argmax(1)
            out += [(side[i][0], int(k), *others[order[first[i]]][1:4]) for i, k in enumerate(on.sum(1)) if k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, found = None, [[], []], []
        for b in batches:
            for fam, i, k, chunk, *rest, items in zip(*(c.to_pylist() for c in b.columns[:-1]), (x.as_buffer() for x in b.column(8)), strict=True):
                if (fam, i, k) != now:
                    found += compare(sides, now is not None and now[1] == now[2])
                    now, sides = (fam, i, k), [[], []]
                sides[chunk != i].append((*rest, np.frombuffer(items, np.uint64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _COUNTED.types, strict=True)], schema=_COUNTED)
                found = []
        found += compare(sides, now is not None and now[1] == now[2])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _COUNTED.types, strict=True)], schema=_COUNTED)

    keys = ("fam", "a", "b")
    return dealt.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "cls long, n_links long, doc_id long, row_key long, line_no int")


def join_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, least: int = 5, space: Workspace | None = None) -> DataFrame:
    """All lines of at least `least` distinct words, and the links between different sets.

    Lines (split at \\n) are sets of words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case.
    Equal sets are a class; its first line in order of (doc_id, row_key, line_no) stands
    for it. Classes are linked if 100 * common >= percent * all their tokens.
    Tokens are ordered by rarity. Classes that share a token of their prefixes are
    candidates after the length, positional and parity filters (_cold_pairs, and wide
    parity maps of larger sets); then full sets are compared. No candidate is left out. Tokens that the prefixes of more
    than GROUP classes share are hot: the many variants of one line are a family there,
    compared in blocks that count links, so that no row is made for each of their pairs;
    classes of different families meet by a join.

    Returns (doc_id, row_key, line_no, n_tokens, cls, n_links, class_doc_id, class_line_no,
    first_doc_id, first_line_no, removed). n_links: other classes linked with the
    line's class. `first_*` is the earliest line of the class and of those linked
    with it; every later line is removed.

    Null or empty text: no lines. A null doc_id comes before all others. Rows that
    share a doc_id, or have none, are told apart by row_key, a hash of the text;
    rows equal in both are one row, whose lines are the same lines.
    Empty tables give empty results. Other columns are not read."""
    space = space or Workspace(docs.sparkSession, "lines")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), row_key(docs[text]).alias("row_key"))
    found = space.write(line_sets(rows, token_levels(rows.select("text")), percent, least), "found")
    lines = space.write(found.select(*PLACE, "n_tokens", "s0", "s1"), "lines")
    place = F.struct(*PLACE)
    one = ("n_tokens", "parity", "skip", "prefix", "wide")
    whole = found.groupBy("s0", "s1").agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in one])
    whole = space.write(whole.withColumn("cls", F.monotonically_increasing_id()), "whole-classes")
    space.drop("found")
    size_place = (F.col("n_tokens").cast("long") * 2**32 + F.col("skip") + F.col("at")).alias("np")
    tokens = whole.select("cls", "n_tokens", "parity", "skip", F.posexplode("prefix").alias("at", "key"))
    met = space.write(_cold_pairs(tokens.select("key", "cls", size_place, "parity"), percent), "met", NARROW_ROWS)
    classes = space.write(whole.select("s0", "s1", "place", "cls"), "classes")
    wide = space.write(whole.where("wide is not null").select("cls", "n_tokens", "wide"), "wide")
    space.drop("whole-classes")
    hot = met.where("hot").select("key", F.col("u").alias("cls"), "np", "parity")
    families = space.write(_families(hot, space), "families")
    facts = space.write(wide.join(families, "cls", "full").select("cls", "fam", "n_tokens", "wide"), "facts")
    space.drop("wide")
    cold = _apart(met.where("not hot").select("u", "v").distinct(), facts, int(percent))
    pairs = space.write(cold.union(_hot_pairs(hot, families, percent)).distinct(), "pairs")
    space.drop("met", "facts")
    dealt = space.write(dealt_pairs(pairs), "dealt")
    space.drop("pairs")
    null = F.lit(None)
    needed = needed_sets(dealt).union(families.select("cls", null.cast("long"), null.cast("int")))
    needed = space.write(needed, "needed")
    asked = space.write(classes.join(needed.select("cls").distinct(), "cls"), "asked-places")
    places = asked.select("cls", *[F.col(f"place.{c}").alias(c) for c in PLACE])
    sets = space.write(_class_sets(rows, places, needed, space), "sets")
    space.drop("needed")
    links = space.write(common_at_places(dealt, sets.where("g is not null")).where(f"100 * common >= {int(percent)} * total"), "links")
    space.drop("dealt")
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    across = both.join(asked.select(F.col("cls").alias("v"), "place"), "v").select(F.col("u").alias("cls"), F.lit(1).cast("long").alias("n_links"), "place")
    own = sets.where("g is null").select("cls", "items")
    inside = _family_counts(families.join(asked.select("cls", "place"), "cls"), own, int(percent)).select("cls", "n_links", place.alias("place"))
    linked = across.union(inside).groupBy("cls").agg(F.sum("n_links").alias("n_links"), F.min("place").alias("near"))
    linked = space.write(linked.join(asked.select("cls", "s0", "s1"), "cls").drop("cls"), "linked")
    space.drop("sets", "links", "families", "asked-places")
    first = F.least("place", F.coalesce("near", "place"))
    # All three are dealt by the digest, so lines and classes are shuffled once.
    out = lines.join(classes, ["s0", "s1"]).join(linked, ["s0", "s1"], "left")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).withColumn("first", first)
    later = F.struct(*map(F.col, PLACE)) > F.col("first")
    return out.select(
        "doc_id", "row_key", "line_no", "n_tokens", "cls", "n_links", F.col("place.doc_id").alias("class_doc_id"), F.col("place.line_no").alias("class_line_no"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), later.alias("removed"),
    )


def drop_lines(docs: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines marked as removed in their own row; all other
    columns as they are, whatever their names. A document of which no word is left goes; others,
    also those without words from the start, stay. A null text stays null."""
    taken = {c.lower() for c in docs.columns}
    doc_id, of, gone = (next(n for n in (f"_{name}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for name in ("doc", "row", "gone"))
    removed = lines.where("removed").groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias(gone))
    removed = removed.withColumnsRenamed({"doc_id": doc_id, "row_key": of})
    split = F.split(docs[text].cast("string"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), docs[text]).otherwise(F.array_join(F.transform(left, lambda i: split[i]), "\n"))
    both = docs.join(removed, docs[key].cast("long").eqNullSafe(removed[doc_id]) & (row_key(docs[text]) == removed[of]), "left")
    both = both.where(F.col(gone).isNull() | kept.rlike("[^\\x20\\x09-\\x0D]"))
    return both.select(*[kept.alias(c) if c == text else docs[c] for c in docs.columns])
