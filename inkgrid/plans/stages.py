"""A plan is a list of stages; each is a function of the tables made so far."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, fuse
from ..operators.state import content_hash, patch_regions

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """name: also of the table it makes. needs: tables; columns: those its table must have."""

    name: str
    make: Callable[[Tables], DataFrame]
    needs: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()


@dataclass
class Run:
    """The tables of a run. Stages are lazy; a folder given, each stage's table is
    written there and read back, so that a replay starts from files."""

    spark: SparkSession
    stages: list[Stage]
    folder: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    observers: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    written: int = 0

    def start(self, **given: DataFrame) -> "Run":
        self.tables = dict(given)
        return self._from(0)

    def rerun_from(self, name: str, **changed: DataFrame) -> "Run":
        """Makes the tables of a stage and of all after it again."""
        at = [s.name for s in self.stages].index(name)
        self.tables.update(changed)
        return self._from(at)

    def _from(self, at: int) -> "Run":
        for s in self.stages[at:]:
            if missing := [n for n in s.needs if n not in self.tables]:
                raise ValueError(f"{s.name} needs {', '.join(missing)}")
            made = s.make(self.tables)
            if missing := [c for c in s.columns if c not in made.columns]:
                raise TypeError(f"{s.name} makes no {', '.join(missing)}")
            if self.folder:
                self.written += 1
                where = f"{self.folder}/{self.written:04d}-{s.name}"  # a replay may read what was there before
                made.write.mode("overwrite").parquet(where)
                made = self.spark.read.schema(made.schema).parquet(where)
            self.tables[s.name] = made
            for watch in self.observers:
                try:
                    watch(s.name, made)
                except Exception as e:  # an observer can't stop a run
                    self.warnings.append(f"{s.name}: {type(e).__name__}: {e}")
        return self

    def fingerprint(self, name: str) -> tuple:
        """Count and digest of a stage's contents; equal after a replay that changed nothing."""
        t = self.tables[name]
        return tuple(content_hash(t, sorted(c for c, k in t.dtypes if "map" not in k)).first())

    def timeline(self) -> DataFrame:
        """The stages in order with the columns they make, and whether they are made."""
        rows = [(i, s.name, list(s.needs), s.name in self.tables) for i, s in enumerate(self.stages)]
        return self.spark.createDataFrame(rows, "place int, stage string, needs array<string>, produced boolean")


    def export(self, run_id: str) -> DataFrame:
        """A row for each table of the run: stage, number of rows, digest of its contents."""
        rows = [(run_id, i, s.name, *self.fingerprint(s.name)) for i, s in enumerate(self.stages) if s.name in self.tables]
        return self.spark.createDataFrame(rows, "run_id string, place int, stage string, n long, parity long, total long")

    def snapshot(self, name: str) -> DataFrame:
        """What is looked at of a stage's table: ids, texts, boxes and scores, as far as it has them."""
        t = self.tables[name]
        shown = ("page", "token_id", "region_id", "line_id", "field_id", "text", "value", "cls", "score", "final", "confidence", "x1", "y1", "x2", "y2")
        return t.select(*[c for c in shown if c in t.columns])


def evidence_plan() -> list[Stage]:
    """Tokens and regions to fields: patch by human operations, align, fuse, value."""
    return [
        Stage("patched_regions", lambda t: patch_regions(t["regions"], t["operations"]) if "operations" in t else t["regions"], ("regions",), ("page", "region_id", "x1")),
        Stage("alignments", lambda t: align.align(t["tokens"], t["patched_regions"]), ("tokens", "patched_regions"), ("token_id", "region_id", "cls", "score")),
        Stage("fields", lambda t: fuse.resolve(fuse.consolidate(t["alignments"])), ("alignments",), ("region_id", "final", "field_id")),
        Stage("valued_fields", lambda t: fuse.with_values(t["fields"], t["alignments"], t["tokens"]), ("fields", "alignments", "tokens"), ("value",)),
    ]


def integrity(run: Run) -> DataFrame:
    """Dangling references between the tables of a run: table, column, id."""
    a, f = run.tables["alignments"], run.tables["fields"]
    bad = a.join(run.tables["tokens"].select("page", "token_id"), ["page", "token_id"], "left_anti").select(F.lit("alignments").alias("table"), F.lit("token_id").alias("column"), "token_id")
    lost = f.join(run.tables["patched_regions"].select("page", "region_id").hint("merge"), ["page", "region_id"], "left_anti").select(F.lit("fields"), F.lit("region_id"), F.col("region_id").cast("string"))
    return bad.union(lost).toDF("table", "column", "id")


def document_plan(eps_y: float = 9.1, gap: float = 30.0) -> list[Stage]:
    """Scanned tokens to cells, fields and a fingerprint for each page. Tokens with an error
    are kept apart, so that a bad page stops no other."""
    from ..functions.text import arabic_chars, label, language, latin_chars, widget
    from ..operators import cluster, quality
    from ..sources.readers import clean_tokens

    def fields(t: Tables) -> DataFrame:
        kind = widget(F.col("text"))
        return cluster.cell_fields(t["cells"], kind, label(F.col("text"), kind))

    def prints(t: Tables) -> DataFrame:
        native = F.count_if(F.col("source") == "native")
        said = t["tokens"].groupBy("page").agg(language(F.sum(arabic_chars(F.col("text"))), F.sum(latin_chars(F.col("text")))).alias("language"), quality.extraction_mode(native, F.count(F.lit(1))).alias("mode"))
        shape = t["cells"].groupBy("page").agg(
            (F.max("col") + 1).alias("n_cols"), (F.max("row") + 1).alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("confidence"), 4).alias("avg_confidence")
        )
        issues = t["fields"].groupBy("page").agg(F.count_if("needs_qa").alias("n_issues"))
        out = shape.join(said, "page").join(issues, "page").join(cluster.page_geometry(t["tokens"]).select("page", "row_height", "col_gap"), "page")
        return out.withColumn("layout_hash", cluster.layout_hash(F.lit(1), F.col("n_cols"), F.col("n_rows"), F.col("row_height"), F.col("col_gap"), F.col("language")))

    return [
        Stage("tokens", lambda t: clean_tokens(t["scanned"]), ("scanned",), ("page", "token_id", "text", "x1")),
        Stage("failed_pages", lambda t: t["scanned"].where("error is not null").select("page", "error").distinct(), ("scanned",), ("page", "error")),
        Stage("cells", lambda t: cluster.layout_cells(cluster.merge_fragments(cluster.row_clusters(t["tokens"], eps_y), gap)), ("tokens",), ("row", "col", "text")),
        Stage("fields", fields, ("cells",), ("widget", "label", "needs_qa")),
        Stage("fingerprints", prints, ("tokens", "cells", "fields"), ("layout_hash",)),
    ]


def ingest(files: DataFrame, blocks: DataFrame, automatic: float = 0.90, review: float = 0.70) -> DataFrame:
    """The outcome of each file: an error from its route or its reader, else the governance
    of its mean confidence; what is below both bounds is quarantined. One bad file is one row."""
    from ..operators.quality import governance

    per = blocks.groupBy("path").agg(F.count("text").alias("n_cells"), F.avg("confidence").alias("_c"), F.max("error").alias("_e"))
    out = files.select("path", F.col("error").alias("_r")).join(per, "path", "left")
    error = F.coalesce("_r", "_e", F.when(F.col("n_cells").isNull(), "no contents"))
    verdict = F.when(error.isNull(), governance(F.col("_c"), automatic, review))
    status = F.when(error.isNotNull(), "error").when(verdict == "QUARANTINE", "quarantined").otherwise("pass")
    return out.select("path", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.round("_c", 4).alias("avg_confidence"), verdict.alias("outcome"), status.alias("status"), error.alias("error"))


def geometry_counts(tokens: DataFrame, regions: DataFrame, lines: DataFrame, on: str = "page") -> DataFrame:
    """How much geometry each page has, by layer, for a look at a run without its images."""
    kinds = [tokens.select(on, F.lit("token").alias("layer")), regions.select(on, F.lit("region")), lines.select(on, F.concat_ws("_", "orientation", F.lit("line")))]
    every = kinds[0].union(kinds[1]).union(kinds[2])
    return every.groupBy(on, "layer").agg(F.count(F.lit(1)).alias("n"))


def overlay(tokens: DataFrame, regions: DataFrame, lines: DataFrame, colors: dict[str, str]) -> DataFrame:
    """The boxes that an overlay of a page shows: layer, color, box; drawing is left to viewers."""
    flat = F.col("orientation") == "horizontal"
    ends = [F.when(flat, F.col(a)).otherwise(F.col(b)).alias(c) for c, a, b in (("x1", "start", "axis"), ("y1", "axis", "start"), ("x2", "stop", "axis"), ("y2", "axis", "stop"))]
    paint = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv])
    box = ("x1", "y1", "x2", "y2")
    layers = [tokens.select("page", F.lit("token").alias("layer"), *box), regions.select("page", F.lit("region").alias("layer"), *box), lines.select("page", F.lit("line").alias("layer"), *ends)]
    return layers[0].unionByName(layers[1]).unionByName(layers[2]).withColumn("color", paint[F.col("layer")])
