"""Readers over made files, tables, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import harvest
from inkgrid.sources import readers, tables
from inkgrid.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return b.getvalue()


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "in" / "icu" / "monitor"
    where.mkdir(parents=True)
    p = lambda t, s="": f'<w:p>{s and f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>"}<w:r><w:t>{t}</w:t></w:r></w:p>'
    (where / "form.docx").write_bytes(archive(word__document_xml=f"<w:document {W}><w:body>{p('Head', 'Heading1')}{p('line')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"))
    (where / "sheet.xlsx").write_bytes(archive(xl__sharedStrings_xml=f"<sst {X}><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {X}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c><v></v></c></row></sheetData></worksheet>'))
    (where / "note.txt").write_text("one\n\ntwo")
    (where / "bad.docx").write_text("no archive")
    (where / "x.zip").write_text("zip")
    done = tmp_path / "in" / "processed"
    done.mkdir()
    (done / "old.txt").write_text("old")
    return str(tmp_path / "in")


def test_office_files(spark, folder):
    files = readers.scan_files(spark, folder)
    assert {(r.form_type, r.route, r.device, r.department) for r in files.collect()} == {("form", "docx", "monitor", "icu"), ("sheet", "xlsx", "monitor", "icu"), ("note", "text", "monitor", "icu"), ("bad", "docx", "monitor", "icu"), ("x", None, "monitor", "icu")}
    rows = readers.read_office(files).collect()
    got = {(r.path.rsplit("/", 1)[1], r.block, r.row, r.cell, r.text) for r in rows if r.error is None}
    assert got == {("form.docx", 0, 0, 0, "line"), ("form.docx", 1, 0, 0, "a"), ("form.docx", 1, 0, 1, "b"), ("sheet.xlsx", 0, 0, 0, "name"), ("sheet.xlsx", 0, 0, 1, "5"), ("note.txt", 0, 0, 0, "one"), ("note.txt", 0, 1, 0, "two")}
    assert [r.error for r in rows if r.error] and len([r for r in rows if r.error]) == 1


def test_page_scans(spark, folder):
    def scanner(content):
        if content == b"no archive":
            raise OSError("unreadable")
        yield {"page": 0, "seq": 0, "text": content.decode("latin-1")[:30], "x1": -5.0, "y1": 0.0, "x2": 50.0, "y2": 10.0, "page_w": 40.0, "page_h": 20.0, "confidence": None, "source": "ocr"}

    got = readers.scan_pages(readers.scan_files(spark, folder), scanner)
    assert got.where("error is not null").count() == 1
    clean = readers.clean_tokens(got).collect()
    assert clean and all((r.x1, r.x2, r.confidence) == (0.0, 40.0, 0.5) for r in clean)
    native = spark.createDataFrame([("a", 0, "x" * 20), ("a", 1, "short")], "path string, page int, text string")
    ocr = spark.createDataFrame([("a", 0, "o0"), ("a", 1, "o1")], "path string, page int, text string")
    assert sorted(r.text for r in readers.native_first(native, ocr).collect()) == ["o1", "x" * 20]


def test_layout_lines_and_keys(spark, tmp_path):
    (tmp_path / "r.txt").write_text('{"type":"table","bbox":[0,0,9,9],"res":[{"text":"t","confidence":0.5,"text_region":[[1,2],[5,2],[5,4],[1,4]]}],"img_idx":0}\n{"type":"figure","bbox":[0,0,1,1],"res":[],"img_idx":0}\n')
    rows = readers.read_layout_lines(spark, str(tmp_path / "r.txt")).orderBy("type").collect()
    assert [(r.type, r.text, r.x1, r.y2) for r in rows] == [("figure", None, None, None), ("table", "t", 1.0, 4.0)]
    key = spark.sql("SELECT timestamp '2024-03-05 00:00:00' AS t").select(readers.object_key(F.lit("a b.pdf"), F.col("t"), F.lit("u"))).first()[0]
    assert key == "uploads/2024/03/05/u_a_b.pdf"


def test_embeddings_and_unknown_names(spark):
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    assert [r.embedding for r in readers.embed(df, "text", lambda b: [[float(len(x))] for x in b]).collect()] == [[3.0], [0.0]]
    labels = spark.createDataFrame([("known", "k"), ("new one", None), ("x", None)], "text string, canonical string")
    assert [r.canonical for r in harvest.name_unknowns(labels, lambda b: {x: x.upper() for x in b}).orderBy("text").collect()] == ["k", "NEW ONE", None]


def test_json_harvest(spark):
    df = spark.createDataFrame([('text ```json {"a": {"sections": [{"label": "Pulse rate"}]}} ``` end',), ("none",)], "t string")
    got = df.select(harvest.rescue_json(F.col("t")).alias("j")).withColumn("f", harvest.find_form(F.col("j"))).withColumn("l", harvest.labels(F.col("j"))).collect()
    assert json.loads(got[0].f) == {"sections": [{"label": "Pulse rate"}]} and got[0].l == ["Pulse rate"] and got[1].j is None


def test_tables_latest_version(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS t1")
    tables.create(spark, "t1.")
    row = lambda v, s: spark.sql(f"SELECT 'd' AS document_id, '{{\"x\":{v}}}' AS data, '{s}' AS qa_status, timestamp '2024-01-01' AS processed_at, {v}L AS version, date '2024-01-01' AS day")
    tables.save(row(1, "pending"), "t1.documents")
    tables.save(row(2, "approved"), "t1.documents")
    assert tables.get(spark, "t1.documents", "document_id", "d", "x int").first().data.x == 2
    assert tables.list_documents(spark, "t1.documents", "approved").count() == 1
    assert tables.list_documents(spark, "t1.documents", "pending").count() == 0


def _stream(spark, tmp_path, rows, schema, build, mode="append"):
    where = str(tmp_path / "stream")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(where)
    out = build(spark.readStream.schema(schema).json(where))
    name = f"s{abs(hash(str(tmp_path))) % 10**8}"
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_ledger_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")]
    got = _stream(spark, tmp_path, rows, "operation_id string, ts string", lambda s: streams.ledger(s.withColumn("ts", F.col("ts").cast("timestamp"))))
    assert sorted(r.operation_id for r in got) == ["a", "b"]


def test_lifecycle_stream(spark, tmp_path):
    rows = [("t", 1, "INGESTED", None), ("t", 2, "LIVE", None), ("t", 3, "EXTRACTED", None), ("t", 4, "QUARANTINED", "system")]
    got = _stream(spark, tmp_path, rows, "key string, seq long, to_state string, actor string", streams.lifecycle)
    assert [(r.seq, r.from_state, r.legal, r.needs_human) for r in sorted(got, key=lambda r: r.seq)] == [(1, None, True, False), (2, "INGESTED", False, False), (3, "INGESTED", True, False), (4, "EXTRACTED", True, True)]


def test_windows_stream(spark, tmp_path):
    rows = [("x", 1.0, "2024-01-01 00:10:00"), ("x", 2.0, "2024-01-01 00:50:00"), ("x", 3.0, "2024-01-02 00:00:00")]
    got = _stream(spark, tmp_path, rows, "event_type string, value double, ts string", lambda s: streams.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    assert sorted((r.n, r.total) for r in got) == [(1, 3.0), (2, 3.0)]


def test_dead_letters(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, None), (2, "bad")], "id int, error string").write.json(src)
    s = spark.readStream.schema("id int, error string").json(src)
    streams.with_dead_letters(s, lambda b: b.write.mode("append").parquet(str(tmp_path / "ok")), str(tmp_path / "dead"), checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [2]


def test_streamed_sessions_and_files(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-01 01:00:00"), (9, "2024-01-09 00:00:00")]
    spark.createDataFrame(rows, "user_id long, t string").selectExpr("user_id", "cast(t AS timestamp) AS ts").coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/events")
    q = streams.sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, str(r.started), r.n) for r in spark.table("sessions_out").collect()}
    assert got >= {(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 12:00:00", 1), (2, "2024-01-01 01:00:00", 1)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    files = streams.new_files(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("files_out").trigger(availableNow=True).start()
    files.awaitTermination(120)
    assert [bytes(r.content) for r in spark.table("files_out").collect()] == [b"one"]
