"""Work and memory of queries follow their input: cases that plans of before took too long or too much for."""

import itertools
import random
import re
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid import catalog
from inkgrid.operators import cluster, structure, templates
from inkgrid.plans import stages
from inkgrid.sources import readers
from inkgrid.views import regions, tokens

TOKEN = "page long, token_id string, x1 double, y1 double, x2 double, y2 double"


def robust(values):
    """numpy's quantiles are those of SQL."""
    q1, q3 = np.quantile(values, [0.25, 0.75])
    near = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    return statistics.median(near if len(values) >= 4 and len(near) >= 2 else values)


def test_geometry_of_a_full_page(spark):
    """Each list of a page is sorted once, not once for each of its values."""
    rnd = random.Random(5)
    rows = [(0, f"t{i}", float(rnd.randint(0, 40000)), 0.0, 50000.0, float(rnd.choice([12, 14, 14, 15, 90]))) for i in range(6000)]
    began = time.time()
    r = cluster.page_geometry(spark.createDataFrame(rows, TOKEN)).first()
    assert time.time() - began < 40
    xs = sorted({round(x[2] / 5) * 5 for x in rows})
    assert r.row_height == robust([x[5] for x in rows])
    assert r.col_gap == robust([b - a for a, b in zip(xs, xs[1:]) if b - a > 3])


def broadcasts(df):
    """The parts of a query's plan that are broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("\n")
    depth = lambda x: len(re.match(r"[\s:+\-*|]*", x)[0])
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            yield [line, *itertools.takewhile(lambda x: depth(x) > depth(line), lines[k + 1 :])]


SPATIAL = (
    "token_region_alignment", "fused_fields", "grid_join_pairs", "best_assignment", "assignment_validation", "nearest_region", "point_hits", "region_containment", "nested_grids",
    "coordinate_firewall", "conflict_edges", "alignment_view", "alignment_snapshots",
)


@pytest.mark.parametrize("name", SPATIAL)
def test_regions_are_not_broadcast(spark, sf_dir, name):
    """A file of regions is small, but not the rows in their cells, nor many regions."""
    for part in broadcasts(catalog.QUERIES[name](spark, sf_dir)):
        assert not any("Generate" in x or "p_partkey" in x for x in part), part


def test_regions_of_runs_are_not_broadcast(spark, sf_dir):
    """nor in the stages that an export looks at."""
    run = stages.Run(spark, stages.evidence_plan()).start(tokens=tokens(spark, sf_dir), regions=regions(spark, sf_dir))
    for df in (*run.tables.values(), stages.integrity(run)):
        for part in broadcasts(df):
            assert not any("Generate" in x or "p_partkey" in x for x in part), part


def union_find(rows, cols, edges):
    """The cells of a grid by their root, merged over open edges."""
    up = {(r, c): (r, c) for r in range(rows) for c in range(cols)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for kind, r, c in edges:
        other = (r - 1, c) if kind == "horizontal" else (r, c - 1)
        if other in up and (r, c) in up:
            a, z = sorted((root(other), root((r, c))))
            up[z] = a
    groups = {}
    for x in up:
        groups.setdefault(root(x), []).append(x)
    return groups


def test_merged_cells_of_random_grids(spark, monkeypatch):
    """some pages at once, of any shape, as one page at a time."""
    rnd = random.Random(6)
    lines = [(page, f"l{k}", kind, float(20 * rnd.randint(0, 7)), float(20 * rnd.randint(0, 4)), float(20 * rnd.randint(3, 8)), 1.0) for page in range(12) for k in range(rnd.randint(4, 24)) for kind in ("horizontal", "vertical")]
    df = spark.createDataFrame(lines, "page long, line_id string, orientation string, axis double, start double, stop double, confidence double")
    edges = structure.grid_edges(df)
    pages = {}
    for e in edges.collect():
        pages.setdefault(e.page, []).append(e)
    want = set()
    for page, own in pages.items():
        rows, cols = max(e.row for e in own if e.orientation == "horizontal"), max(e.col for e in own if e.orientation == "vertical")
        for (r, c), cells in union_find(rows, cols, [(e.orientation, e.row, e.col) for e in own if e.is_inferred]).items():
            want.add((page, r, c, max(x[0] for x in cells), min(x[1] for x in cells), max(x[1] for x in cells), len(cells)))
    assert len(pages) > 8
    for at_once in (1, 100, 1 << 19):
        monkeypatch.setattr(structure, "AT_ONCE", at_once)
        for got in (structure.merged_cells(edges), structure.merged_grid_cells(df)):
            assert {(x.page, x.root_row, x.root_col, x.row_end, x.col_start, x.col_end, x.n_cells) for x in got.collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_grids_have_no_row_or_lambda_for_each_edge(spark, sf_dir):
    """merged cells make no row for an edge, and edges are looked up among the steps that lines cover."""
    assert "Generate" not in plan(catalog.QUERIES["merged_cells"](spark, sf_dir))
    for name in ("grid_edges", "page_grids"):
        df = catalog.QUERIES[name](spark, sf_dir)
        assert "exists(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_axes_of_a_page_are_listed_once(spark, sf_dir):
    """not with each of its lines, in a window."""
    for name in ("gap_audit", "filled_lines"):
        assert "collect_set(" not in "".join(x for x in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x)


@pytest.mark.parametrize("name", ["sheet_cells", "image_lines"])
def test_made_files_are_dealt_to_all_tasks(spark, sf_dir, name):
    """rows of a small file, or of small partitions, from which Python makes large files."""
    assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cells_of_many_files(spark):
    """readers give the cells of a few files at once; a file that fails in its midst is one row."""
    files = spark.createDataFrame([(f"f{k}", "text", bytearray("\n".join(f" {k} {i} " for i in range(k)).encode())) for k in range(300)] + [("bad", "xlsx", bytearray(b"no zip"))], "path string, route string, content binary").coalesce(1)
    cells = readers.read_office(files)
    assert "Pandas" not in plan(cells)
    got = cells.collect()
    assert [(x.path, x.error) for x in got if x.error] == [("bad", "BadZipFile: File is not a zip file")]
    assert {(x.path, x.row, x.text) for x in got if not x.error} == {(f"f{k}", i, f"{k} {i}") for k in range(300) for i in range(k)}


def prints_of(spark, rnd, n, cells, counts):
    rows = [(k, {c: rnd.choice(counts) for c in rnd.sample(cells, rnd.randint(1, 8))}) for k in range(n)]
    return spark.createDataFrame([(k, m, sum(m.values()), float(1 + k % 3)) for k, m in rows], "id long, cells map<int,long>, regions long, aspect double")


@pytest.mark.parametrize(("cells", "counts", "limit"), [(range(100), (1, 2, 3), 1000), (range(100), (1, 40, 41), 7), (range(-3, 200), (1, 15, 16, 17), 7), (range(-9, -1), (1, 2), 7), (range(150, 160), (3,), 1000)])
def test_best_templates_of_any_counts(spark, cells, counts, limit):
    """bits of counts, and the rest of maps, give the same minima as all differences."""
    rnd = random.Random(7)
    left, right = prints_of(spark, rnd, 40, list(cells), counts), prints_of(spark, rnd, 25, list(cells), counts)
    pairs = left.crossJoin(right.select(*[F.col(c).alias(f"t_{c}") for c in right.columns]))
    keys = F.array_union(F.map_keys("cells"), F.map_keys("t_cells"))
    part = lambda m, c: F.coalesce(F.try_element_at(F.col(m), c), F.lit(0))
    gap = F.aggregate(keys, F.lit(0).cast("bigint"), lambda s, c: s + F.abs(part("cells", c) - part("t_cells", c)))
    every = pairs.select("id", F.struct(F.round(templates.drift(F.col("regions"), F.col("t_regions"), F.col("aspect"), F.col("t_aspect"), gap), 6).alias("drift"), F.col("t_id").alias("t")).alias("b"))
    want = {(r.id, r.b.t, r.b.drift) for r in every.groupBy("id").agg(F.min("b").alias("b")).collect() if r.b.drift <= 0.8}
    assert {(r.id, r.template_id, r.drift) for r in templates.best_templates(left, right, most=0.8, limit=limit).collect()} == want and want


def test_pairs_of_templates_need_no_lambda(spark, sf_dir):
    """maps are turned to bits before layouts and templates meet."""
    joined = "".join(x for x in catalog.QUERIES["best_templates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x or "HashAggregate" in x or "array_min" in x)
    assert "lambda" not in joined and "Join" in joined


def test_dense_cells_need_no_join(spark, sf_dir):
    """tokens are placed from one list of their page, and empty cells are what it leaves out."""
    assert "Join" not in plan(catalog.QUERIES["nearest_cells"](spark, sf_dir))


def test_cells_of_tokens_of_one_id(spark):
    """two tokens of one id are each in the rows of both, as when rows are joined by the id; those without one are in none."""
    rows = [(0, "a", 0.0, 0.0, 10.0, 10.0, "p", 0.5), (0, "a", 0.0, 100.0, 10.0, 110.0, "q", 0.5), (0, "b", 200.0, 0.0, 210.0, 10.0, "r", 0.5), (0, None, 0.0, 200.0, 10.0, 210.0, "s", 0.5), (None, "a", 0.0, 0.0, 10.0, 10.0, "t", 0.5)]
    got = cluster.nearest_cells(spark.createDataFrame(rows, TOKEN + ", text string, confidence double")).collect()
    assert sorted((x.row, x.col, x.text) for x in got) == [(0, 0, "p q"), (0, 1, "r"), (1, 0, "p q"), (1, 1, "")]
