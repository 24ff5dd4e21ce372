"""Encoding, packing, id files, sharding: exact round trips and plain models."""

import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgrid.llm import idfiles, packing, sharding
from inkgrid.llm.encoding import Encoder

from .helpers import edge_docs, empty, prose, table, with_clashes

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "\n", "  \n\n a", "<|endoftext|> x", "a b\x1cc", "it's 'tis don't\n\n\n  x  ", "日本語 123abc!!??\r\n\t x", "é" * 5, "👍🏽 ok", " " * 30 + "x", "'s's 's", "x²³ ½", "a_b __ c", " x\u0085y", "١٢ ३", "x\n'll y"]


def test_encoder_equals_library(whole):
    rnd = random.Random(1)
    own = Encoder(PATH, cache_words=50)
    texts = ODD + ["".join(rnd.choice("ab Zé.,'!\n\t0_²日👍-") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    for t in texts:
        assert own.encode(t).tolist() == whole(t)
    assert [x.tolist() for x in own.encode_all(texts)] == [whole(t) for t in texts]


def test_special_tokens_are_the_librarys(whole):
    assert whole("<|endoftext|> x")[0] == 50256
    text = "a b<|endoftext|>c " * 3 + prose(random.Random(3), 50)
    assert Encoder(PATH).encode(text).tolist() == whole(text)


def test_encoder_slices_long_texts(whole, monkeypatch):
    monkeypatch.setattr("inkgrid.llm.encoding.SLICE", 50)
    text = prose(random.Random(2), 400) + "nospace" * 40
    assert Encoder(PATH).encode(text).tolist() == whole(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 9, 5000])
def test_file_round_trip(kind, n):
    rnd = np.random.default_rng(n)
    docs = [(None if i == 1 else i, rnd.integers(0, 50_000 if i % 2 else 2**32, int(k), dtype=np.uint64).astype(np.uint32)) for i, k in enumerate(rnd.integers(0, max(n, 1), 6))]
    sink = io.BytesIO()
    w = idfiles.FileWriter(sink, kind, chunk_ids=64)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    got = [(d, at, np.concatenate([np.zeros(0, np.uint32), *p]).tolist()) for d, at, p in idfiles.read_documents(sink.getvalue())]
    at = np.cumsum([0] + [len(x) for _, x in docs]).tolist()
    assert got == [(d, at[i], x.tolist()) for i, (d, x) in enumerate(docs)]
    with pytest.raises(ValueError):
        idfiles.read_footer(sink.getvalue()[:-1])


def test_id_files_of_edge_docs(spark, whole):
    docs = edge_docs(spark)
    got = idfiles.read_ids(*idfiles.write_ids(with_clashes(docs), PATH)).collect()
    want = {}
    for r in docs.collect():
        ids = np.array([*whole(r.text), 0], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    found, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):  # in ascending order of ids, rows of one id in any order, without gaps
        assert r.start == at
        at += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    order = [d for d in found if d is not None]
    assert next(iter(found)) is None and order == sorted(order)
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in want.items()}
    assert idfiles.read_ids(*idfiles.write_ids(empty(spark), PATH)).count() == 0


def test_rows_of_one_key_are_spread(spark):
    docs = spark.range(4000).selectExpr("cast(null AS bigint) AS doc_id", "'same text' AS text").repartition(4)
    folder, manifest = idfiles.write_ids(docs, PATH)
    assert manifest.agg(F.max("n_docs")).first()[0] < 2500 and idfiles.read_ids(folder, manifest).count() == 4000
    got = sharding.shard_documents(docs).collect()
    assert sorted(r.slot for r in got) == list(range(4000))


def check_packing(pieces, capacity):
    bins = {}
    for length, s, o in pieces:
        bins.setdefault(s, []).append((o, length))
    for b in bins.values():
        at = 0
        for o, length in sorted(b):
            assert o == at
            at += length
        assert at <= capacity
    return len(bins)


def place(lengths, capacity):
    hist = {w: lengths.count(w) for w in set(lengths)}
    rows, seen, out = packing.plan(hist, capacity), {}, []
    for w in lengths:
        r = seen.get(w, 0)
        seen[w] = r + 1
        _, first, _, run, seq, off = next(x for x in rows.tolist() if x[0] == w and x[1] <= r < x[1] + x[2])
        out.append((w, seq + (r - first) // run, off + (r - first) % run * w))
    return out


def optimum(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(5)
    for _ in range(250):
        capacity = rnd.randint(8, 30)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = packing.reduce_dominated(counts, capacity)
        rest = [w for w in range(capacity + 1) for _ in range(counts[w])]
        assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(lengths, capacity)
        n = check_packing(place(lengths, capacity), capacity)
        assert n <= optimum(lengths, capacity) + 1


def test_large_histogram_is_tight():
    rnd = random.Random(6)
    lengths = [2048] * 3000 + [rnd.randint(1, 2048) for _ in range(3000)] + [7] * 2000
    n = check_packing(place(lengths, 2048), 2048)
    assert n <= 1.01 * -(-sum(lengths) // 2048)


def test_packing_of_edge_docs(spark, whole):
    docs = edge_docs(spark)
    got = packing.pack_documents(with_clashes(docs), PATH, capacity=64, keep_ids=True).collect()
    check_packing([(r.length, r.sequence_id, r.offset) for r in got], 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    want = []
    for r in docs.collect():
        ids = [*whole(r.text), 0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want += [(r.doc_id, k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id or -1, r.piece, r.start, r.length) for r in got)) == sorted((d or -1, *x) for d, *x in want)
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_sharding(spark):
    docs = edge_docs(spark).unionByName(spark.range(100, 400).selectExpr("id AS doc_id", "concat('t', id) AS text", "'x' AS lang", "'s' AS source", "1L AS n_chars"))
    got = sharding.shard_documents(with_clashes(docs)).collect()
    assert len(got) == docs.count()
    for s in range(16):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r.grown_shard for r in got if r.grown_shard != r["shard"]} == {16}
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts}
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert {(r.doc_id, r["shard"]) for r in again} == {(r.doc_id, r["shard"]) for r in got}
    heavy = sharding.shard_documents(docs, weights=(3.0, 1.0)).collect()
    assert 0.65 < sum(r["shard"] == 0 for r in heavy) / len(heavy) < 0.85
    assert not table(sharding.shard_documents(empty(spark)))
    plan = sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
