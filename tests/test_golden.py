"""Golden evidence cases: tokens and boxes to alignments and fused fields."""

import json

import pytest
from pyspark.sql import functions as F

from inkgrid.operators import align, fuse
from inkgrid.plans.stages import Run, evidence_plan, integrity
from inkgrid.sources import readers

CASES = {
    "multi_region_conflict": ([[180, 60, 220, 80], [55, 60, 150, 80]], [[50, 50, 200, 90], [200, 50, 350, 90]], {0: (2, 1, 1, 0.70), 1: (1, 0, 0, 0.05)}),
    "touching_boundary": ([[47, 60, 49, 80], [60, 60, 150, 80], [700, 700, 800, 720]], [[50, 50, 250, 90]], {0: (2, 1, 1, 0.70)}),
    "merged_cells": ([[55, 55, 200, 70], [55, 75, 200, 90], [55, 95, 200, 110]], [[50, 50, 250, 130]], {0: (3, 3, 6, 0.40)}),
    "orphan_recovery": ([[60, 60, 150, 80], [265, 55, 320, 75], [800, 800, 900, 820]], [[50, 50, 250, 90]], {0: (2, 1, 1, 0.70)}),
    "human_override": ([[60, 60, 150, 80]], [[50, 50, 250, 90]], {0: (1, 1, 0, 0.80)}),
}


def evidence(spark, tmp_path, tokens, boxes):
    doc = {"ocr": {"source_engine": "x", "page_number": 0, "tokens": [{"bbox": t, "text": f"t{i}", "confidence": 0.9} for i, t in enumerate(tokens)]}, "geometry": {"lines": [{"bbox": [0, 5, 100, 5], "orientation": "horizontal", "confidence": 1.0}], "boxes": [{"bbox": b, "confidence": 0.9} for b in boxes]}}
    path = tmp_path / "case.json"
    path.write_text(json.dumps(doc))
    return readers.read_evidence(spark, str(path))


@pytest.mark.parametrize("name", CASES)
def test_case(spark, tmp_path, name):
    tokens, boxes, want = CASES[name]
    e = evidence(spark, tmp_path, tokens, boxes)
    fields = fuse.resolve(fuse.consolidate(align.align(readers.evidence_tokens(e), readers.evidence_regions(e)))).collect()
    assert {r.region_id: (r.n, r.k, r.conflicts) for r in fields} == {k: v[:3] for k, v in want.items()}
    for r in fields:
        assert r.final == pytest.approx(want[r.region_id][3], abs=1e-6)


def test_overlap_figures(spark, tmp_path):
    e = evidence(spark, tmp_path, [[180, 60, 220, 80]], [[50, 50, 200, 90]])
    r = align.align(readers.evidence_tokens(e), readers.evidence_regions(e)).first()
    assert (r.cls, r.iou, r.intersection, r.coverage, r.region_coverage, r.distance) == ("crosses", 0.0625, 400.0, 0.5, 0.0667, 75.0)


def test_lines_are_padded(spark, tmp_path):
    e = evidence(spark, tmp_path, [[0, 0, 1, 1]], [[0, 0, 1, 1]])
    r = readers.evidence_lines(e).first()
    assert (r.y1, r.y2, r.axis, r.start, r.stop) == (5.0, 5.1, 5.0, 0.0, 100.0)


def test_plan_replay_and_rejection(spark, tmp_path):
    tokens, boxes, _ = CASES["multi_region_conflict"]
    e = evidence(spark, tmp_path, tokens, boxes)
    seen = []
    run = Run(spark, evidence_plan(), str(tmp_path / "run"))
    run.observers += [lambda name, t: seen.append(name), lambda name, t: 1 / 0]
    run.start(tokens=readers.evidence_tokens(e), regions=readers.evidence_regions(e))
    assert seen == ["patched_regions", "alignments", "fields", "valued_fields"] and len(run.warnings) == 4
    before = run.fingerprint("fields")
    assert run.rerun_from("alignments").fingerprint("fields") == before
    assert integrity(run).count() == 0
    assert run.tables["valued_fields"].where("region_id = 0").first().value == "t1"
    ops = spark.createDataFrame([("line_rejection", [1])], "operation_type string, target_evidence_ids array<bigint>")
    run.rerun_from("patched_regions", operations=ops)
    assert [r.region_id for r in run.tables["fields"].collect()] == [0]
    assert run.fingerprint("fields") != before
    assert run.timeline().where("produced").count() == 4


def test_plan_contract(spark):
    with pytest.raises(ValueError):
        Run(spark, evidence_plan()).start(tokens=spark.range(1))


def test_final_score_is_clamped(spark):
    one = spark.range(1).select(fuse.final_score(*[F.lit(x) for x in (1.0, 1.0, 1.0, 0.0, 0.0, 5.0)]).alias("a"), fuse.final_score(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0, 1.0, 0.0)]).alias("b")).first()
    assert (one.a, one.b) == (1.0, 0.0)
