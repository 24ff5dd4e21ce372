"""WARC archives: written by tasks, read back by verified chains of records."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions

MAGIC = b"WARC/1.1\r\n"
# The profile of revisits with equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task begins another file, and bytes of a reader's split.
FILE_BYTES, SPLIT_BYTES = 1 << 25, 1 << 22
#: Bytes that are read at once for a record's header; more are read if it does not end in them.
HEADER_BYTES = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit without it. Both say the payload's
    digest and length (the latter in a field of its own, X-Payload-Length)."""
    fields = {"WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": date, "Content-Type": "application/http;msgtype=response"}
    if url:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Payload-Length": str(len(payload))}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}, http)


#: Says that the data ends within a header.
CUT = object()


def read_header(data: bytes, at: int) -> tuple[dict[str, str], int, int] | object | None:
    """(fields, where the block begins, its length) of a record at a place; None if
    there is none: no magic, a line without a name, or no valid length; CUT if the
    data ends before the header does."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    fields, begin = {}, at + len(MAGIC)
    while (end := data.find(b"\r\n", begin)) != begin:
        if end < 0:
            return CUT
        name, colon, value = data[begin:end].partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        begin = end + 2
    length = fields.get("content-length", "")
    return (fields, end + 2, int(length)) if length.isascii() and length.isdigit() else None


def _whole_header(f, data: bytes, begin: int, size: int, at: int) -> tuple[tuple[dict[str, str], int, int] | None, bytes]:
    """The header at a place of the data, which begin at a place of the file, and
    the data with what had to be read for it."""
    while (header := read_header(data, at)) is CUT and begin + len(data) < size:
        more = f.read_at(min(max(len(data) - at, HEADER_BYTES), size - begin - len(data)), begin + len(data))
        if not more:
            break
        data += more
    return None if header is CUT else header, data


def write_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, space: Workspace | None = None) -> tuple[str, DataFrame]:
    """Writes a record per row; returns the folder and the table of files (file, bytes).

    Of rows with equal payloads (UTF-8 html; null: empty) of at least
    `least_bytes`, that with the largest key is the response and the others
    revisit it; smaller payloads are all responses. Rows that repeat the
    response's key and payload are responses as well; rows without a key are
    responses unless one with a key has the payload. Payloads are grouped by
    digest, counted before they are joined. A task writes under a name of its
    own and renames at the end, so that it may run again."""
    from pyspark import TaskContext

    space = space or Workspace(pages.sparkSession, "warc")
    folder = f"{space.path}/archives"
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    large = rows.where(F.octet_length("html") >= least_bytes)
    groups = large.groupBy(sha.alias("sha")).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null").select("sha", "top")
    copies = large.select("page_id", sha.alias("sha")).join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("top"))).select("sha", "page_id", "top").distinct()
    # Written first, so that Spark knows its size: if it is small, the pages aren't shuffled to meet it.
    copies = space.write(copies, "copies")
    marked = rows.withColumn("sha", sha).join(copies.withColumnsRenamed({"sha": "_sha", "page_id": "_id"}), (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, where = fs.FileSystem.from_uri(folder)
        to.create_dir(where, recursive=True)
        task, sink, size, names, sizes = TaskContext.get(), None, 0, [], []

        def close() -> None:
            nonlocal sink
            sink.close()
            to.move(tmp, f"{where}/{name}")
            names.append(name)
            sizes.append(size)
            sink = None

        for b in batches:
            for page_id, link, text, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    name = f"pages-{task.partitionId():06d}-{len(names):04d}.warc"
                    tmp = f"{where}/.{name}.{task.taskAttemptId()}"
                    sink = to.open_output_stream(tmp)
                    first = record("warcinfo", {"WARC-Record-ID": f"<urn:file:{name}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    size = sink.write(first)
                size += sink.write(page_record(page_id, link, text.encode(), top, date))
                if size >= FILE_BYTES:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return folder, space.write(marked.select("page_id", "url", "html", "top").mapInArrow(write, "file string, bytes long"), "files")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the archives of a folder, by Spark's listing; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def _open(folder: str):
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    return lambda file: store.open_input_file(f"{where}/{file}")


def _candidates(folder: str, split_bytes: int):
    """For mapInArrow over (file, bytes, split): (file, at, out) for each place of the
    split that looks like a record: `out` is where its chain leaves the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _open(folder)
        for b in batches:
            for file, size, split in zip(*(c.to_pylist() for c in b.columns), strict=True):
                begin = split * split_bytes
                end = min(begin + split_bytes, size)
                after = {}
                with opened(file) as f:
                    data = f.read_at(min(end + HEADER_BYTES, size) - begin, begin)
                    at = data.find(MAGIC)
                    while 0 <= at < end - begin:
                        header, data = _whole_header(f, data, begin, size, at)
                        if header:
                            after[begin + at] = begin + header[1] + header[2] + 4
                        at = data.find(MAGIC, at + 1)
                out = {}
                for place in sorted(after, reverse=True):
                    out[place] = out.get(after[place], after[place])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(out), pa.string()), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["file", "at", "out"])

    return run


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_READ_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _records(folder: str, split_bytes: int, keep_payload: bool, strict: bool):
    """For mapInArrow over (file, bytes, at): the records of the chain from a verified
    place to the end of its split. A response's payload must have its digest. If
    strict, each place must be a record that ends within the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _open(folder)
        for b in batches:
            for file, size, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                end, rows = min((at // split_bytes + 1) * split_bytes, size), []
                with opened(file) as f:
                    while at < end:
                        header, head = _whole_header(f, f.read_at(min(HEADER_BYTES, size - at), at), at, size, 0)
                        if strict and (header is None or at + header[1] + header[2] + 4 > size):
                            raise ValueError(f"{file} at {at}: no whole record")
                        if header is None:
                            break
                        fields, begin, length = header
                        kind = fields.get("warc-type")
                        if kind in ("response", "revisit"):
                            block = head[begin : begin + length] if begin + length <= len(head) else f.read_at(length, at + begin)
                            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                            said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                            if payload is not None and digest(payload) != said:
                                raise ValueError(f"{file} at {at}: the payload doesn't have its digest")
                            n = len(payload) if payload is not None else int(fields["x-payload-length"]) if "x-payload-length" in fields else None
                            rows.append((_number(fields.get("warc-record-id")), fields.get("warc-target-uri"), n, said, kind, _number(fields.get("warc-refers-to")), payload if keep_payload else None))
                        at += begin + length + 4
                        if len(rows) >= 200:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)

    return run


def read_pages(folder: str, files: DataFrame, keep_payload: bool = False, split_bytes: int = SPLIT_BYTES, space: Workspace | None = None, strict: bool = False) -> DataFrame:
    """The response and revisit records of archives (file, bytes) of a folder.

    Tasks scan splits for the magic and give each candidate record its successor,
    followed to where the chain leaves the split. Magic inside payloads gives
    candidates as well. Only places that some chain leaves to, and file starts,
    can begin a split's part of the true chain; among these, pointers from the
    start of each file are doubled until no further place is reached. Then each
    split is read from its verified place on. What no chain from a file's start
    reaches is no record. If `strict`, for archives that are known to be whole, it is
    an error if a file does not begin with a record, or if a chain reaches a place
    that is no record or does not end at the end of its file. Null pages and empty folders give no rows."""
    spark = files.sparkSession
    space = space or Workspace(spark, "warc-read")
    n = partitions(spark)
    splits = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {split_bytes}"))).alias("split"))
    found = splits.repartition(n, "file", "split").mapInArrow(_candidates(folder, split_bytes), "file string, at long, out long")
    found = space.write(found, "candidates")
    entries = found.select("file", F.col("out").alias("at")).union(found.where("at = 0").select("file", "at")).distinct()
    jump = space.write(found.join(entries, ["file", "at"]), "jump-0")
    reached = files.where("bytes > 0").select("file", F.lit(0).cast("long").alias("at"))
    k, before, now = 0, -1, -2
    while now != before:
        k += 1
        further = jump.join(reached, ["file", "at"]).select("file", F.col("out").alias("at"))
        reached = space.write(reached.union(further).distinct(), f"reached-{k}")
        ahead = jump.select("file", F.col("at").alias("out"), F.col("out").alias("next"))
        jump = space.write(jump.join(ahead, ["file", "out"], "left").select("file", "at", F.coalesce("next", "out").alias("out")), f"jump-{k}")
        space.drop(f"jump-{k - 1}")
        before, now = now, reached.count()
    starts = files.join(reached, "file").where("at < bytes").select("file", "bytes", "at")
    return starts.repartition(n, "file", "at").mapInArrow(_records(folder, split_bytes, keep_payload, strict), _READ_SQL)
