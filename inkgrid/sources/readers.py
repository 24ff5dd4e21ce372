"""Readers of evidence JSON, layout JSON lines, office files, texts and page scans.

Every reader returns DataFrames. Files that can't be read give rows with an error
instead of failing the job."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import stable_id

# File types by suffix, the least characters of a native text page,
# confidences of texts without their own.
ROUTES = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xls": "xlsx", "doc": "doc", "txt": "text", "md": "text", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image"}
NATIVE_CHARS = 20
CONFIDENCE = {"ocr": 0.5, "raw_line": 0.85, "doc": 0.7}
EVIDENCE = """ocr STRUCT<source_engine: STRING, engine_version: STRING, page_width: INT, page_height: INT, page_number: INT,
  tokens: ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, text: STRING, confidence: DOUBLE, space: STRING>>>,
  geometry STRUCT<meta: STRUCT<page_width: INT, page_height: INT, original_space: STRING>,
  lines: ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, orientation: STRING, confidence: DOUBLE>>, boxes: ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, confidence: DOUBLE>>>"""


def parse_evidence(df: DataFrame, body: str) -> DataFrame:
    """Evidence documents from a column of JSON texts."""
    return df.select(F.from_json(body, EVIDENCE).alias("_e")).select("_e.*").withColumn("page", F.coalesce("ocr.page_number", F.lit(0)).cast("long"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents: one JSON object per line or file."""
    return spark.read.schema(EVIDENCE).option("multiLine", True).json(path).withColumn("page", F.coalesce("ocr.page_number", F.lit(0)).cast("long"))


def _corners(b: str) -> list[Column]:
    return [F.col(b)[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]


def evidence_tokens(evidence: DataFrame) -> DataFrame:
    """Tokens of evidence documents, with content ids."""
    out = evidence.select("page", F.col("ocr.source_engine").alias("source"), F.posexplode("ocr.tokens").alias("seq", "t")).select("page", "source", "seq", F.col("t.text").alias("text"), F.col("t.confidence").alias("confidence"), *_corners("t.bbox"))
    return out.withColumn("token_id", stable_id(F.col("page"), F.col("x1"), F.col("y1"), F.col("text"), F.col("source")))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """Lines with degenerate sides padded, as boxes and as axis, start and stop."""
    out = evidence.select("page", F.posexplode("geometry.lines").alias("seq", "l")).select("page", "seq", F.col("l.orientation").alias("orientation"), F.col("l.confidence").alias("confidence"), *_corners("l.bbox"))
    wide = g.padded(g.box())
    out = out.withColumns(dict(zip(("x1", "y1", "x2", "y2"), wide, strict=True)))
    flat = F.col("orientation") == "horizontal"
    ends = {"axis": F.when(flat, F.col("y1")).otherwise(F.col("x1")), "start": F.when(flat, F.col("x1")).otherwise(F.col("y1")), "stop": F.when(flat, F.col("x2")).otherwise(F.col("y2"))}
    return out.withColumns(ends).withColumn("line_id", stable_id(F.lit("line"), F.col("page"), F.col("seq"), F.col("axis"), F.col("start")))


def evidence_regions(evidence: DataFrame) -> DataFrame:
    """A region for each box; region_id numbers a page's boxes, region_key is a content id."""
    out = evidence.select("page", F.posexplode("geometry.boxes").alias("region_id", "b")).select("page", F.col("region_id").cast("long").alias("region_id"), F.col("b.confidence").alias("confidence"), *_corners("b.bbox"))
    box_id = stable_id(F.lit("box"), F.col("page"), *g.box())
    return out.withColumn("region_key", F.sha2(F.concat(F.lit("region"), box_id), 256))


_LAYOUT = "type STRING, bbox ARRAY<DOUBLE>, img_idx BIGINT, res ARRAY<STRUCT<text: STRING, confidence: DOUBLE, text_region: ARRAY<ARRAY<DOUBLE>>>>"


def read_layout_lines(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON lines: a row per recognised text, or one per region without any."""
    return layout_lines(spark.read.schema(_LAYOUT).json(path))


def parse_layout(df: DataFrame, body: str) -> DataFrame:
    """The same from a column of JSON texts."""
    return layout_lines(df.select(F.from_json(body, _LAYOUT).alias("_l")).select("_l.*"))


def layout_lines(raw: DataFrame) -> DataFrame:
    out = raw.select("type", "img_idx", "bbox", F.posexplode_outer("res").alias("seq", "r"))
    corners = [c.alias(n) for c, n in zip(g.polygon_box(F.col("r.text_region")), ("x1", "y1", "x2", "y2"), strict=True)]
    return out.select("type", "img_idx", "bbox", "seq", F.col("r.text").alias("text"), F.col("r.confidence").alias("confidence"), *corners)


def named_files(files: DataFrame) -> DataFrame:
    """Files (path) with their route, department, device and form type from the path.
    Folders named processed are left out. A file that no reader takes has an error."""
    parts = F.split("path", "/")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    route = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[ext]
    named = files.where(~F.lower("path").contains("/processed/"))
    return named.withColumns({"route": route, "form_type": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), "device": F.element_at(parts, -2), "department": F.element_at(parts, -3), "error": F.when(route.isNull(), F.concat(F.lit("no reader for "), ext))})


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The files below a root, named by named_files. Contents are read only if used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return named_files((reader.option("pathGlobFilter", glob) if glob else reader).load(root))


def object_key(name: Column, at: Column, unique: Column) -> Column:
    """The key of an upload: by date, with a unique part and a safe name."""
    return F.concat(F.lit("uploads/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), unique, F.lit("_"), F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"))


def stored_objects(files: DataFrame, name: str, at: str, unique: str, content: str) -> DataFrame:
    """What the object store keeps of uploads: key, checksum, size and content. The rows are
    written to any table or store, under the key."""
    body = F.col(content).cast("binary")
    return files.withColumns({"object_key": object_key(F.col(name), F.col(at), F.col(unique)), "checksum": F.sha2(body, 256), "n_bytes": F.octet_length(body)})


#: Cells that a reader gives at once, about.
CELLS = 1 << 12
_BLOCKS = "path string, block int, block_type string, title string, row int, cell int, text string, confidence double, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _docx(data: bytes) -> Iterator[tuple]:
    """Tables as blocks of rows; paragraphs grouped under their headings."""
    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(data)).read("word/document.xml"))[0]
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    block, title, row = -1, None, 0
    for child in body:
        if child.tag == f"{_W}tbl":
            block += 1
            for r, tr in enumerate(child.iter(f"{_W}tr")):
                for c, tc in enumerate(tr.iter(f"{_W}tc")):
                    yield block, "table", title, r, c, text(tc)
            row = -1
        elif child.tag == f"{_W}p" and text(child):
            style = child.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and str(style.get(f"{_W}val")).startswith("Heading"):
                title, row = text(child), -1
                continue
            if row < 0 or block < 0:
                block, row = block + 1, 0
            yield block, "form", title, row, 0, text(child)
            row += 1


_LETTERS, _SHEET = re.compile("[A-Za-z]*"), re.compile(r"xl/worksheets/sheet(\d+)\.xml")


@lru_cache(1 << 12)
def _place(letters: str) -> int:
    out = 0
    for x in letters.upper():
        out = 26 * out + ord(x) - 64
    return out - 1


def _column(reference: str) -> int:
    """The column of a cell reference: of C7, 2."""
    return _place(_LETTERS.match(reference)[0])


def _xlsx(data: bytes) -> Iterator[tuple]:
    """A block per sheet with its rows that are not empty."""
    book = zipfile.ZipFile(BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
    sheets = sorted((n for n in names if _SHEET.fullmatch(n)), key=lambda n: int(_SHEET.fullmatch(n)[1]))
    for block, sheet in enumerate(sheets):
        row = 0
        for tr in ElementTree.fromstring(book.read(sheet)).iter(f"{_X}row"):
            cells: list[str | None] = []
            for c in tr.iter(f"{_X}c"):
                v = c.find(f"{_X}v")
                at = _column(c.get("r")) if c.get("r") else len(cells)  # cells without contents may be left out
                cells += [None] * (at - len(cells))
                if v is None:
                    cells.append("".join(t.text or "" for t in c.iter(f"{_X}t")))
                else:
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            if any(x and x.strip() for x in cells):
                for k, x in enumerate(cells):
                    yield block, "table", sheet.rsplit("/", 1)[1], row, k, (x or "").strip()
                row += 1


def _text(data: bytes) -> Iterator[tuple]:
    for row, line in enumerate(x for x in data.decode("utf-8", "replace").split("\n") if x.strip()):
        yield 0, "mixed", None, row, 0, line.strip()


def with_headers(cells: DataFrame) -> DataFrame:
    """Marks the header cells: the first row of each table."""
    return cells.withColumn("is_header", F.coalesce((F.col("block_type") == "table") & (F.col("row") == 0), F.lit(False)))


def read_office(files: DataFrame, doc: Callable[[bytes], str] | None = None) -> DataFrame:
    """Cells of docx, xlsx and text files: (block, row, cell); a file that fails gives
    one row with its error. Other routes are left to page scanners. Binary .doc files need
    `doc`, a function from contents to text; without it they are errors."""

    def old(data: bytes) -> Iterator[tuple]:
        if doc is None:
            raise ValueError("no reader for binary .doc files is given")
        return _text(doc(data).encode())

    parsers = {"docx": _docx, "xlsx": _xlsx, "text": _text, "doc": old}

    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (c.split() for c in _BLOCKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        out: list[tuple] = []
        for b in batches:
            for at in range(b.num_rows):  # the cells of one file at a time, in batches of about CELLS
                path, route, content = (c[at].as_py() for c in b.columns)
                conf = CONFIDENCE["doc"] if route in ("text", "doc") else 1.0
                try:
                    out += [(path, *cell, conf, None) for cell in parsers[route](bytes(content))]
                except Exception as e:  # one bad file is one row
                    out.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if len(out) >= CELLS:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return files.where(F.col("route").isin(*parsers)).select("path", "route", "content").mapInArrow(run, _BLOCKS)


_TOKENS = "path string, page int, seq int, text string, x1 double, y1 double, x2 double, y2 double, page_w double, page_h double, confidence double, source string, error string"


def scan_pages(files: DataFrame, scanner: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Tokens from page scanners (PDF text, OCR), which are passed in: scanner(content)
    yields dicts of the token columns. A page or file that fails is a row with an error."""
    names = [c.split()[0] for c in _TOKENS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out += [{"path": path, **t} for t in scanner(bytes(content))]
                except Exception as e:
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            rows = pd.DataFrame(out, columns=names).astype(object)
            yield rows.where(rows.notna(), None)

    return files.select("path", "content").mapInPandas(run, _TOKENS)


def native_words(words: DataFrame, on: tuple[str, ...] = ("path", "page")) -> DataFrame:
    """Words of a page's own text, from points to pixels by the scale of each axis (pt_w, pt_h
    to page_w, page_h), clamped to the page, without empty texts and degenerate boxes. Pages
    of under NATIVE_CHARS characters have none."""
    enough = words.groupBy(*on).agg(F.sum(F.length(F.trim("text"))).alias("_n")).where(F.col("_n") >= NATIVE_CHARS).select(*on)
    scale = {"x": F.col("page_w") / F.col("pt_w"), "y": F.col("page_h") / F.col("pt_h")}
    moved = words.withColumns({c: F.col(c) * scale[c[0]] for c in ("x1", "y1", "x2", "y2")})
    return clean_tokens(moved.join(enough, list(on), "left_semi").withColumns({"confidence": F.lit(1.0), "source": F.lit("native"), "error": F.lit(None).cast("string")}))


def recognised_words(found: DataFrame) -> DataFrame:
    """Tokens of texts recognised in an image, whose outlines are polygons of [x, y]."""
    corners = dict(zip(("x1", "y1", "x2", "y2"), g.polygon_box(F.col("polygon")), strict=True))
    return clean_tokens(found.withColumns({**corners, "source": F.lit("ocr"), "error": F.lit(None).cast("string")}).drop("polygon"))


def raw_lines(pages: DataFrame, tokens: DataFrame, on: tuple[str, ...] = ("path", "page")) -> DataFrame:
    """The fallback for pages without tokens: each line of their raw text is a row of one cell."""
    bare = pages.join(tokens.select(*on).distinct(), list(on), "left_anti")
    lines = bare.select(*on, F.posexplode(F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x) != "")).alias("row", "text"))
    return lines.withColumns({"text": F.trim("text"), "col": F.lit(0), "block_type": F.lit("mixed"), "confidence": F.lit(CONFIDENCE["raw_line"])})


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens clamped to their page, without empty texts and degenerate boxes."""
    inside = g.clamped(g.box(), F.col("page_w"), F.col("page_h"))
    out = tokens.where("error is null").withColumns(dict(zip(("x1", "y1", "x2", "y2"), inside, strict=True)))
    return out.where((F.trim("text") != "") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("confidence", F.coalesce("confidence", F.lit(CONFIDENCE["ocr"])))


def native_first(native: DataFrame, ocr: DataFrame, force_ocr: bool = False, on: tuple[str, ...] = ("path", "page")) -> DataFrame:
    """Native tokens of pages with enough characters; OCR tokens of the others."""
    if force_ocr:
        return ocr
    good = native.groupBy(*on).agg(F.sum(F.length("text")).alias("_n")).where(F.col("_n") >= NATIVE_CHARS).select(*on)
    return native.join(good, list(on), "left_semi").unionByName(ocr.join(good, list(on), "left_anti"))


def embed(df: DataFrame, text: str, client: Callable[[list[str]], list[list[float]]], most: int = 2000, attempts: int = 3) -> DataFrame:
    """Adds `embedding` from a client that takes a batch of texts; null where it keeps failing."""

    @F.pandas_udf("array<float>")
    def run(s):
        import pandas as pd

        batch = [(x or "")[:most] for x in s]
        for _ in range(attempts):
            try:
                return pd.Series(client(batch))
            except Exception:  # tried again; a batch that fails to the end has no vectors
                continue
        return pd.Series([None] * len(batch))

    return df.withColumn("embedding", run(F.col(text)))


def chunk_text(cells: Column) -> Column:
    """The cells of a row that are not empty, joined by bars."""
    return F.array_join(F.filter(cells, lambda c: F.trim(c) != ""), " | ")
