"""Operators against plain models on random and small tables."""

import random

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as g
from inkgrid.functions import text as tx
from inkgrid.operators import align, analytics, cluster, fuse, quality, render, state, structure, templates

TOKEN = "page long, token_id string, x1 double, y1 double, x2 double, y2 double"


def scene(spark, seed, n, m):
    rnd = random.Random(seed)

    def box(w, h):
        x, y = rnd.randint(0, 800), rnd.randint(0, 800)
        return (float(x), float(y), float(x + rnd.randint(1, w)), float(y + rnd.randint(1, h)))

    t = [(rnd.randint(0, 1), f"t{i}", *box(80, 40)) for i in range(n)]
    r = [(rnd.randint(0, 1), i, *box(400, 300)) for i in range(m)]
    return t, r, spark.createDataFrame(t, TOKEN), spark.createDataFrame(r, TOKEN.replace("token_id string", "region_id long"))


@pytest.mark.parametrize("halo", [0.0, 20.0])
def test_grid_join_equals_naive(spark, halo):
    t, r, td, rd = scene(spark, 1, 60, 25)
    want = sorted((a[1], b[1]) for a in t for b in r if a[0] == b[0] and a[2] <= b[4] + halo and a[4] >= b[2] - halo and a[3] <= b[5] + halo and a[5] >= b[3] - halo)
    got = sorted((x.token_id, x.r_region_id) for x in align.grid_join(td, rd, ["page"], halo).collect())
    assert got == want and got


def test_islands_equal_components(spark):
    rnd = random.Random(2)
    rows = [(0, f"{i:03d}", 0.0, float(v), 1.0, float(v)) for i, v in enumerate(rnd.choices(range(400), k=60))]
    got = {r.token_id: r.row for r in cluster.row_clusters(spark.createDataFrame(rows, TOKEN), 5.0).collect()}
    ys = sorted({r[3] for r in rows})
    label, k = {}, 0
    for i, y in enumerate(ys):
        k += i > 0 and y - ys[i - 1] > 5
        label[y] = k
    assert got == {r[1]: label[r[3]] for r in rows}


def test_conflicts_equal_edges(spark):
    rnd = random.Random(3)
    rows = [(0, rnd.randint(0, 5), f"t{i}", rnd.choice(["inside", "crosses", "touching"]), 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "page long, region_id long, token_id string, cls string, score double")
    for r in fuse.consolidate(df).collect():
        own = [x for x in rows if x[1] == r.region_id]
        ordered = sum(a is not b and a[3] == b[3] == "inside" for a in own for b in own)
        others = sum(not (a[3] == b[3] == "inside") for i, a in enumerate(own) for b in own[i + 1 :])
        assert r.conflicts == ordered + others
    assert fuse.conflict_edges(df).count() == sum(len([x for x in rows if x[1] == k]) * (len([x for x in rows if x[1] == k]) - 1) // 2 for k in range(6))


def test_geometry_golden(spark):
    rows = [(0, f"t{i}", 60.0 * i, 0.0, 60.0 * i + 30, 25.0) for i in range(8)]
    r = cluster.page_geometry(spark.createDataFrame(rows, TOKEN)).first()
    assert (r.row_height, r.col_gap, r.eps_y, round(r.eps_x, 6)) == (25.0, 60.0, 16.25, 33.0)
    r = cluster.page_geometry(spark.createDataFrame(rows[:2], TOKEN)).first()
    assert (r.row_height, r.col_gap, r.eps_y, r.eps_x) == (20.0, 30.0, 15.0, 20.0)


def options_model(fields):
    out, i = [], 0
    heads = ("text", "number", "date", "checkbox")
    while i < len(fields):
        col, name, kind = fields[i]
        if kind in heads:
            j, opts = i + 1, []
            while j < len(fields) and not fields[j][1].rstrip().endswith(":") and (fields[j][2] == "checkbox" or fields[j][2] == "text" and len(fields[j][1]) < 20):
                opts.append(fields[j][1])
                j += 1
            if len(opts) >= 2 or len(opts) == 1 and name.rstrip().endswith(":"):
                out.append((col, name.replace(":", "").strip(), "select", "|".join(opts)))
                i = j
                continue
        out.append((col, name, kind, ""))
        i += 1
    return out


def test_option_groups_equal_scan(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for row in range(60):
        own = []
        for col in range(rnd.randint(1, 7)):
            kind = rnd.choice(["text", "text", "checkbox", "date", "textarea"])
            own.append((col, rnd.choice(["a", "b:", "long label of more than twenty", "c"]) + str(col) + rnd.choice(["", ":"]), kind))
        rows += [(0, row, *f) for f in own]
        want[row] = options_model(own)
    df = spark.createDataFrame(rows, "page long, row int, col int, label string, widget string")
    got = {}
    for r in cluster.group_options(df).orderBy("row", "col").collect():
        got.setdefault(r.row, []).append((r.col, r.label, r.widget, r.options))
    assert got == want


def test_leader_is_not_island(spark):
    rows = [(0, str(i), "horizontal", float(a), 0.0, 50.0, 1.0) for i, a in enumerate([0, 4, 8, 12, 13])]
    df = spark.createDataFrame(rows, "page long, line_id string, orientation string, axis double, start double, stop double, confidence double")
    got = {r.axis: r.leader for r in cluster.leader_axes(df).collect()}
    assert got == {0.0: 0.0, 4.0: 0.0, 8.0: 8.0, 12.0: 8.0, 13.0: 8.0}


def test_gaps_use_running_reach(spark):
    rows = [(0, "h", 0.0, 0.0, 100.0), (0, "h", 0.0, 10.0, 20.0), (0, "h", 0.0, 101.0, 110.0), (0, "h", 0.0, 150.0, 160.0)]
    df = spark.createDataFrame(rows, "page long, orientation string, leader double, start double, stop double")
    assert [(r.gap_start, r.gap_stop) for r in cluster.line_gaps(df).collect()] == [(110.0, 150.0)]


def test_merged_cells(spark):
    rows = [(0, f"h{i}", "horizontal", 100.0 * i, 0.0, 200.0, 1.0) for i in range(3)] + [(0, "v0", "vertical", 0.0, 0.0, 200.0, 1.0), (0, "v1", "vertical", 100.0, 0.0, 100.0, 1.0), (0, "v2", "vertical", 200.0, 0.0, 200.0, 1.0)]
    df = spark.createDataFrame(rows, "page long, line_id string, orientation string, axis double, start double, stop double, confidence double")
    got = sorted((r.row_start, r.col_start, r.rowspan, r.colspan, r.is_merged) for r in structure.merged_cells(structure.grid_edges(df)).collect())
    assert got == [(0, 0, 1, 1, False), (0, 1, 1, 1, False), (1, 0, 1, 2, True)]


def test_running_mean_rows(spark):
    rows = [(0, f"{i}", 0.0, y, 1.0, y) for i, y in enumerate([0.0, 10.0, 24.0, 26.0, 60.0])]
    got = {r.token_id: r.row for r in cluster.nearest_rows(spark.createDataFrame(rows, TOKEN)).collect()}
    assert got == {"0": 0, "1": 0, "2": 1, "3": 1, "4": 2}


def test_box_columns(spark):
    row = spark.createDataFrame([(10.0, 20.0, 110.0, 70.0)], "x1 double, y1 double, x2 double, y2 double")
    b = g.box()
    out = row.select(*[c.alias(f"n{i}") for i, c in enumerate(g.normalized(b, F.lit("page_pixels"), F.lit(1000.0), F.lit(100.0)))], g.unproject(F.lit(7.0), F.lit(2.0), F.lit(1.0)).alias("u"), g.unproject(F.lit(7.0), F.lit(0.0), F.lit(1.0)).alias("z"), g.hex_color(F.lit(255), F.lit(0), F.lit(16)).alias("c"), g.evidence_score(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("s")).first()
    assert tuple(out) == (0.01, 0.2, 0.11, 0.7, 3.0, 0.0, "#1000ff", 1.0)
    with pytest.raises(Exception, match="points"):
        row.select(*g.pixels(b, F.lit("pdf_points"), F.lit(1.0), F.lit(1.0))).collect()


@pytest.mark.parametrize(("text", "kind"), [("", "text"), (None, "text"), ("☐", "checkbox"), ("[ ] yes", "checkbox"), ("1/2/2024", "date"), ("- / -", "date"), ("تاريخ الميلاد", "date"), ("رقم", "number"), ("١٢٣", "number"), ("ملاحظات", "textarea"), ("a\nb", "textarea"), ("x" * 121, "textarea"), ("name", "text")])
def test_widgets(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(tx.widget(F.col("t"))).first()[0] == kind


def test_arabic_text(spark):
    df = spark.createDataFrame([("ﻣﺮﺣﺒﺎ", False), ("abc def", True)], "t string, r boolean")
    got = df.select(tx.has_presentation_forms(F.col("t")).alias("f"), tx.fix_arabic(F.col("t"), F.col("r")).alias("x")).collect()
    assert [tuple(r) for r in got] == [(True, "مرحبا"), (False, "abc def")]
    n = df.select(tx.language(tx.arabic_chars(F.lit("مرحبا abc")), tx.latin_chars(F.lit("مرحبا abc")))).first()[0]
    assert n == "ar_en"


def test_synonyms_and_labels(spark):
    df = spark.createDataFrame([(" Fall Rate ",), ("the fall rate of june",), ("nothing",)], "text string")
    assert [r.canonical for r in tx.synonyms(df).collect()] == ["fall_rate", "fall_rate", None]
    got = spark.createDataFrame([("☐ yes",), ("☐",)], "t string").select(tx.label(F.col("t"), F.lit("checkbox"))).collect()
    assert [r[0] for r in got] == ["yes", "اختيار"]


def test_quarantine_and_governance(spark):
    rows = [(0.9, 1, 0, 4, 0, 4, "pdf"), (0.5, 1, 0, 4, 0, 4, "pdf"), (0.4, 1, 0, 4, 0, 4, "pdf"), (0.9, 0, 0, 0, 0, 0, "pdf"), (0.9, 1, 2, 4, 3, 0, "pdf")]
    df = spark.createDataFrame(rows, "avg_confidence double, n_blocks int, n_empty_blocks int, n_cells int, n_empty_cells int, n_boxed_cells int, file_type string")
    assert [r.status for r in quality.quarantine(df).collect()] == ["pass", "warning", "hard_stop", "warning", "hard_stop"]
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.7,), (None,)], "c double").select(quality.governance(F.col("c"))).collect()] == ["AUTO_PASS", "QA_REVIEW", "QUARANTINE"]


def test_drift_edges(spark):
    prints = spark.createDataFrame([(1, {1: 2}, 2, 1.0), (2, {1: 1, 3: 1}, 2, 1.0)], "id long, cells map<int,long>, regions long, aspect double")
    got = {(r.id, r.template_id, r.drift) for r in templates.best_templates(prints, prints, most=1.0).collect()}
    assert got == {(1, 1, 0.0), (2, 2, 0.0)}
    blocks = {(r.id, r.template_id, r.drift) for r in templates.best_templates(prints, prints, most=1.0, limit=1).collect()}
    assert blocks == got
    lineage = spark.createDataFrame([(1, "op1", "line_rejection", [7])], "template_id long, operation_id string, operation_type string, target_evidence_ids array<long>")
    runs = spark.createDataFrame([("r1", 1, 0.1, 5), ("r2", 1, 0.3, 6)], "run_id string, template_id long, drift double, first_region_id long")
    s = templates.suggest_corrections(lineage, runs).collect()
    assert [(x.run_id, x.target_evidence_ids, x.confidence) for x in s] == [("r1", [5], 0.9)]


def test_operation_fields_and_store(spark):
    ops = spark.createDataFrame([("a", "region_split", {"source_region": "1"}), ("b", "nonsense", None), ("c", "line_approval", None)], "operation_id string, operation_type string, payload map<string,string>")
    assert {r.operation_id: r.missing for r in state.validate_operations(ops).collect()} == {"a": ["split_coordinates"], "b": ["operation_type"], "c": []}
    new = ops.select(F.col("operation_id").alias("artifact_id"))
    assert sorted(r[0] for r in state.write_once(new.where("artifact_id = 'a'"), new.union(new)).collect()) == ["b", "c"]


def test_wide_nulls_in_latest(spark):
    df = spark.createDataFrame([(1, None, 1, None), (1, "x", 2, None), (2, "y", 1, 5)], "k int, v string, version int, w int")
    assert {tuple(r) for r in state.latest_wins(df, ["k"], ["version"]).collect()} == {(1, "x", 2, None), (2, "y", 1, 5)}


def test_rendered_forms(spark):
    f = spark.createDataFrame([("d", "f1aaaaaaaa", "[x]", 0.5), ("d", "f2bbbbbbbb", None, 0.4)], "doc_id string, field_id string, value string, final double")
    form = render.panels(render.canonical_documents(f)).first().form
    assert '"type":"checkbox"' in form and '"title":"Main Content"' in form
    grid = spark.createDataFrame([(0, 0, 0, "a", 1.0), (0, 0, 1, "b", 1.0), (0, 1, 0, "", 0.0), (0, 1, 1, "", 0.0)], "page long, row int, col int, text string, confidence double")
    assert [(r.row, r.is_header) for r in render.table_rows(grid).collect()] == [(0, True)]
    field = "named_struct('key', '{k}', 'label', '{l}', 'field_type', '{t}', 'is_fatal', true, 'required', true, 'options', cast(null AS array<struct<value:string,label:string>>))"
    docs = spark.sql(f"SELECT 'd' AS doc_id, array(named_struct('id', 's', 'label', 'S', 'fields', array({field.format(k='k', l='L', t='pass_fail')}, {field.format(k='i', l='I', t='kpi_indicator')}))) AS sections")
    assert [(r.key, r.is_fatal) for r in render.flat_criteria(docs).collect()] == [("k", True)]
    shown = render.canonical_components(docs).collect()
    assert [(r.type, r.css, [v.value for v in r.values or []]) for r in shown] == [("radio", "fatal-field", ["pass", "fail"]), ("htmlelement", "kpi-indicator", [])]


def test_priors(spark):
    r = spark.range(1).select(analytics.PRIORS["alignment"](F.lit(0.9)).alias("a"), analytics.PRIORS["fill"](F.lit(0.3)).alias("b")).first()
    assert (r.a, r.b) == (0.95, 0.5)
