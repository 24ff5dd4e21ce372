"""The pipeline's stages and queries over the smallest tables, against plain models."""

import random

import pytest

import corpus_pipeline
from inkgrid.llm import queries
from inkgrid.llm.common import table

from .helpers import edge_docs, empty, prose, with_clashes
from .test_text import base, line_model, near_model


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out, docs = [], table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        out.append((name, before, docs))
    return {n: (b, d) for n, b, d in out}


def test_stage_columns(stages, spark, sf_dir):
    columns = table(spark, sf_dir, "documents").columns
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    assert all(d.columns == columns for n, (_, d) in stages.items() if n != "pack")


def test_quality_stage(stages, spark, sf_dir):
    before, after = stages["quality"]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    for r in before.collect():
        n, _, _, _, again = base(r.text)
        if n < 50 or 100 * again > 50 * n:
            assert r.doc_id not in kept
        elif labels.get(r.doc_id) == 1:
            assert r.doc_id in kept


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = line_model(rows)
    kept = {r.doc_id: r for r in after.collect()}
    for d, t in rows:
        own = {k: v[-1] for (x, k), v in want.items() if x == d}
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if not own.get(k))
        if left != t and not left.split():
            assert d not in kept
        else:
            assert kept[d].text == left and kept[d].n_chars == len(left)


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    _, comp = near_model([(r.doc_id, r.text) for r in before.collect()], 5)
    assert {r.doc_id for r in after.collect()} == {d for d, c in comp.items() if d == c}


def test_leak_stage(stages, spark, sf_dir):
    before, after = stages["decontaminate"]
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        if any(t in r.text for t in items):
            assert r.doc_id not in kept


def test_pack_stage(stages):
    before, after = stages["pack"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    ends = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in ends) <= 2048


def test_short_lines_are_joined_by_the_query(spark, tmp_path):
    rows = [(1, "Read more\none two three four"), (2, "read MORE\nOne two three four\n\n"), (3, "word " * 9 + "\n" + "word")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.n_tokens, r.n_links, (r.class_doc_id, r.class_line_no), (r.first_doc_id, r.first_line_no), r.removed) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == line_model(rows, least=1) and sum(v[-1] for v in got.values()) == 3


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_with_other_columns(spark, sf_dir, tmp_path, name):
    for t in ("documents", "pages", "labels", "benchmark"):
        with_clashes(table(spark, sf_dir, t)).limit(40).write.parquet(f"{tmp_path}/{t}.parquet")
    queries.QUERIES[name](spark, str(tmp_path)).count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_rows(spark, sf_dir, name):
    """Nulls, blanks, ties, repeated and very long rows and clashing names; and empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = with_clashes(edge_docs(spark))
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)
    every = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
    if name == "pack":
        assert sorted(set(got)) == sorted(set(every)) and stage(spark, empty(spark), sf_dir).count() == 0
        return
    assert out.columns == docs.columns
    want = {
        "quality": [], "line_dedup": every, "decontaminate": every,
        # 4 and 5 are equal texts, as are 6 and 7; both rows of 5 go.
        "near_dedup": [-1, -1, 1, 2, 3, 4, 6, 8, 9, 10, 11],
    }[name]
    assert got == want
    assert stage(spark, empty(spark), sf_dir).count() == 0


def test_rows_without_ids_are_deduplicated_and_decontaminated(spark, sf_dir):
    rnd = random.Random(30)
    a, b = prose(rnd, 80), prose(rnd, 80)
    item = next(r.text for r in table(spark, sf_dir, "benchmark").collect() if len(r.text.split()) > 10)
    rows = [(None, a), (None, a), (3, b), (None, b), (4, f"{prose(rnd, 60)} {item}"), (4, prose(rnd, 70)), (None, f"{item} {prose(rnd, 60)}"), (5, a), (5, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text in (a, b)) for r in left) == [(0, False), (3, True), (4, False), (4, False), (5, True)]
    clean = corpus_pipeline.decontaminate(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0) for r in clean) == [0, 0, 0, 3, 4, 5, 5]
