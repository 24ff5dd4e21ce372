"""MinHash near-duplicates: SuperMinHash, banding, exact check, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .components import UnionFind, components
from .setcheck import common_items, common_matrix
from .sketch import KeyFilter
from .words import _GOLD, column_words, mix, pieces_by_bytes, text_shingles

#: Classes of a family on one side of a block.
BLOCK = 256


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n_docs x m) of many sets at once.

    Element e of set owner[e] takes, in round j, the place that a random
    permutation of its own has at j, with the value j plus a random fraction;
    a place keeps its least value. Values of later rounds are larger, so a set
    is ready as soon as the places all have values below the next round: large
    sets after a round or two, and only small ones go on."""
    sig = np.full(n_docs * m, np.inf)
    x, own = elements, owner.astype(np.int64)
    first: np.ndarray | None = None
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(x):
            break
        z = mix(x + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            first = place = k
        elif j == 1:
            place = np.where(k == first, 0, k)
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, own * m + place, j + (z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        ready = sig.reshape(n_docs, m).max(1) <= j + 1
        on = ~ready[own]
        if j == 1:  # from here on a few small sets go on, with their permutations
            f, s = first[on], k[on]
            rows = np.arange(len(f))
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(f), 1))
            for i, chosen in ((0, f), (1, s)):
                held = perm[rows, chosen]
                perm[rows, chosen] = perm[:, i]
                perm[:, i] = held
        if not on.all():
            x, own = x[on], own[on]
            if j == 0:
                first = first[on]
            elif j > 1:
                perm = perm[on]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` places, with the band in it."""
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * _GOLD + bits[:, :, i])
    return h.view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _text_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, in order."""
    items, sizes = text_shingles(column_words(column), k)
    ends = np.cumsum(sizes)
    return [np.unique(items[z - n : z]) for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _sketches(docs: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """doc_id, set size, 128-bit digest of the set and band keys; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_by_bytes(batch, 1, 1 << 19):
                sets = _text_sets(b.column(1), k)
                sizes = np.array([len(s) for s in sets])
                bands = band_keys(super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), m), rows)
                ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()), mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64)), ids, lists], schema=_SKETCH)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def _sets(rows: DataFrame, asked: DataFrame, k: int, space: Workspace) -> DataFrame:
    """(cls, items) of the asked classes. Only texts whose ids pass a filter of the asked
    ones are shuffled to meet them."""
    asked = space.write(asked, "asked")
    known = rows.sparkSession.sparkContext.broadcast(KeyFilter(asked, asked.count()))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(known.value(b.column(0).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_by_bytes(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in _text_sets(b.column(1), k)], pa.binary())], names=["cls", "items"])

    texts = rows.where("doc_id is not null").mapInArrow(some, "doc_id long, text string").join(asked, "doc_id", "left_semi")
    return texts.mapInArrow(run, "cls long, items binary")


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def block_links(ids: list[list[int]], labels: list[list[int]], sets: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of two lists of sets, as a forest: with all common
    counts from products of 0/1 matrices over the items that more than one set has."""
    size = [np.array([len(x) for x in side]) for side in sets]
    common = common_matrix(*sets)
    total = size[0][:, None] + size[1][None, :] - common
    apart = np.array(labels[0])[:, None] != np.array(labels[1])[None, :]
    forest, out = UnionFind(), []
    for i, k in np.argwhere((100 * common >= percent * total) & apart).tolist():
        a, b = forest.root(labels[0][i]), forest.root(labels[1][k])
        if a != b:
            forest.join(a, b)
            out.append((ids[0][i], ids[1][k]))
    return out


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (fam, cls, label) of a family with different labels.

    The largest label of a family is one side's chunks, all others the other's; each
    chunk of others meets each chunk in a block of its own. So a member is sent to as
    many blocks as its family has chunks, and no pairs are rows."""
    per = members.groupBy("fam", "label").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("fam").agg(F.max(F.struct("n", "label")).alias("t"), F.sum("n").alias("all")).where("t.n < all")
    top = top.select("fam", F.col("t.label").alias("top"), F.ceil(F.col("t.n") / BLOCK).alias("tops"), F.ceil((F.col("all") - F.col("t.n")) / BLOCK).alias("others"))
    rows = members.join(top, "fam")
    is_top = F.col("label") == F.col("top")
    chunk = F.pmod(F.xxhash64("cls"), F.when(is_top, F.col("tops")).otherwise(F.col("others")))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)
    # A block is (chunk of others, side, chunk): side 0 meets the largest label, side 1 the others from that chunk on.
    as_left = F.concat(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tops") - 1), lambda k: F.struct(chunk.alias("a"), F.lit(0).alias("side"), k.alias("b"), F.lit(0).alias("half"))),
        F.transform(F.filter(other, lambda k: k >= chunk), lambda k: F.struct(chunk.alias("a"), F.lit(1).alias("side"), k.alias("b"), F.lit(0).alias("half"))),
    )
    as_right = F.transform(F.filter(other, lambda k: k <= chunk), lambda k: F.struct(k.alias("a"), F.lit(1).alias("side"), chunk.alias("b"), F.lit(1).alias("half")))
    to_top = F.transform(other, lambda k: F.struct(k.alias("a"), F.lit(0).alias("side"), chunk.alias("b"), F.lit(1).alias("half")))
    blocks = rows.select("fam", "cls", "label", F.explode(F.when(is_top, to_top).otherwise(F.concat(as_left, as_right))).alias("k")).select("fam", "cls", "label", "k.*")
    dealt = sets.join(blocks, "cls").select("fam", "a", "side", "b", "half", "cls", "label", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, halves = None, None
        found: list[tuple[int, int]] = []

        def close() -> None:
            if now is not None and halves[0][0] and halves[1][0]:
                found.extend(block_links(*([h[i] for h in halves] for i in range(3)), percent))

        for b in batches:
            for fam, i, side, k, half, cls, label, items in zip(*(c.to_pylist() for c in b.columns[:-1]), (x.as_buffer() for x in b.column(7)), strict=True):
                if (fam, i, side, k) != now:
                    close()
                    now, halves = (fam, i, side, k), (([], [], []), ([], [], []))
                for to, x in zip(halves[half], (cls, label, np.frombuffer(items, np.uint64)), strict=True):
                    to.append(x)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_LINKS)
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_LINKS)

    keys = ("fam", "a", "side", "b")
    return dealt.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, m: int = 240, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * common >= percent * total shingles. Equal sets
    make one class, which its least doc_id stands for. Classes that share a band
    are candidates (at 80 percent, 40 bands of 6 miss a pair with a chance of
    5e-6). All classes of a band are checked against its least class. Then each
    candidate pair is settled, without making all pairs of a band:
    - classes linked already, by whatever path, need no check;
    - families are the components of checked pairs at a distance of twice that of
      a link; within them, classes with different labels are compared in blocks;
    - pairs of a band from different families are checked one by one, unless their
      distances to its least class differ too much (Jaccard distance is a metric).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. With fewer words
    than `shingle`, the whole sequence is the one shingle. Null or empty text:
    no shingles, linked with nothing. A null doc_id: linked with nothing,
    component_id null, kept. Rows with one doc_id are one node. An empty table
    gives an empty result. Sets are compared by 64-bit hashes of their shingles."""
    spark = docs.sparkSession
    space = Workspace(spark, "neardup")
    rows_in = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    sketches = space.write(_sketches(rows_in, shingle, m, rows), "sketches")
    real = sketches.where("doc_id is not null and set_id is not null")
    classes = space.write(real.groupBy("set_id").agg(F.min("doc_id").alias("cls")), "classes")
    banded = real.join(classes.select("set_id", F.col("cls").alias("doc_id")), ["set_id", "doc_id"]).select(F.col("doc_id").alias("cls"), F.explode("bands").alias("band")).distinct()
    found = space.write(banded.groupBy("band").agg(F.min("cls").alias("u"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    many = space.write(banded.join(found.where("n > 2").select("band", "u"), "band").select("band", "u", F.col("cls").alias("v")), "many")
    pairs = space.write(found.where("n = 2").select("u", F.col("last").alias("v")).union(many.where("u <> v").select("u", "v")).distinct(), "pairs")
    involved = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = space.write(_sets(rows_in, involved, shingle, space), "sets")
    checked = space.write(common_items(pairs, sets), "checked")
    linked = f"100 * common >= {int(percent)} * total"
    links = checked.where(linked).select("u", "v")
    labels = components(links, space, "labels").select(F.col("u").alias("cls"), F.col("v").alias("label"))
    near = f"100 * common >= {100 - 2 * (100 - int(percent))} * total"
    families = components(checked.where(near).select("u", "v"), space, "families")
    # A family's least member is in no row of `families` on the left.
    families = families.select(F.col("u").alias("cls"), F.col("v").alias("fam")).union(families.select(F.col("v").alias("cls"), F.col("v").alias("fam")).distinct())
    members = families.join(labels, "cls", "left").select("cls", "fam", F.coalesce("label", "cls").alias("label"))
    members = space.write(members, "members")
    within = space.write(_family_links(members, sets, int(percent)), "within")
    apart = checked.select("u", "v", (1 - F.col("common") / F.col("total")).alias("d")).groupBy("u", "v").agg(F.min("d").alias("d"))
    known = members.select(F.col("cls").alias("v"), "fam")
    placed = many.join(apart, ["u", "v"], "left").join(known, "v", "left").select("band", "v", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("fam", "v").alias("fam"))
    mixed = placed.groupBy("band").agg(F.min("fam").alias("a"), F.max("fam").alias("b")).where("a <> b").select("band")
    placed = space.write(placed.join(mixed, "band", "left_semi"), "mixed")
    x, y = placed.alias("x"), placed.alias("y")
    cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.fam") != F.col("y.fam")) & (F.abs(F.col("x.d") - F.col("y.d")) <= 1 - percent / 100 + 1e-9))
    cross = cross.select(F.col("x.v").alias("u"), F.col("y.v").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
    cross = space.write(cross, "cross")
    more = links.union(within)
    if not cross.isEmpty():
        more = more.union(common_items(cross, sets).where(linked).select("u", "v"))
    # Labels stand for their members, so only links between labels are followed.
    last = components(labels.select(F.col("cls").alias("u"), F.col("label").alias("v")).union(more), space, "components")
    own = real.select("set_id", "doc_id").distinct().join(classes, "set_id")
    top = own.join(last.select(F.col("u").alias("cls"), F.col("v").alias("top")), "cls", "left").select("doc_id", "set_id", F.coalesce("top", "cls").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_id").join(top, ["doc_id", "set_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
