"""Token-id files: fixed-size id blocks as byte or bit planes under zstandard.

File: MAGIC, then each chunk's planes one after another, then the footer, the
footer's length (8 bytes, little-endian) and MAGIC again. The footer is JSON
under zstandard: the plane kind, ids per chunk, and for each chunk its place,
the compressed size of each plane and its number of ids; then the document index
(doc_ids and token counts, each a zstandard frame of 64-bit integers, base64).
Documents follow each other without gaps and may cross chunks."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .encoding import encoder
from .words import pieces_by_bytes

MAGIC = b"INKPLN01"
CHUNK_IDS = 1 << 16
FILE_IDS = 1 << 22
END_ID = 0


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of 32-bit ids, lowest first, without empty top planes."""
    if kind == "byte":
        grid = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    else:
        grid = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1)
    planes = [np.ascontiguousarray(p) for p in grid]
    while len(planes) > 1 and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class FileWriter:
    """Writes one file; the ids of a chunk at most are kept."""

    def __init__(self, sink, kind: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3):
        import zstandard

        self.sink, self.kind, self.chunk_ids = sink, kind, chunk_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.kept: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.chunks: list[list] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.kept.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= self.chunk_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.kept) if self.kept else np.zeros(0, np.uint32)
        k = 0
        while len(ids) - k >= self.chunk_ids or last and k < len(ids):
            block = ids[k : k + self.chunk_ids]
            planes = [self.pack(p) for p in to_planes(block, self.kind)]
            self.sink.write(b"".join(planes))
            self.chunks.append([self.at, [len(p) for p in planes], len(block)])
            self.at += sum(map(len, planes))
            k += len(block)
        self.kept, self.waiting = [ids[k:].copy()], len(ids) - k

    def close(self) -> None:
        self._flush(last=True)
        index = lambda x: base64.b64encode(self.pack(np.array(x, "<i8").tobytes())).decode()
        nulls = [i for i, d in enumerate(self.docs) if d is None]
        footer = {"kind": self.kind, "chunk_ids": self.chunk_ids, "chunks": self.chunks, "null_docs": nulls, "docs": index([d or 0 for d in self.docs]), "sizes": index(self.sizes)}
        body = self.pack(json.dumps(footer).encode())
        self.sink.write(body + len(body).to_bytes(8, "little") + MAGIC)


def read_footer(data: bytes) -> dict:
    import zstandard

    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a token-id file, or cut short")
    end = len(data) - len(MAGIC) - 8
    n = int.from_bytes(data[end : end + 8], "little")
    unpack = zstandard.ZstdDecompressor().decompress
    footer = json.loads(unpack(data[end - n : end]))
    for k in ("docs", "sizes"):
        footer[k] = np.frombuffer(unpack(base64.b64decode(footer[k])), "<i8")
    return footer


def read_chunks(data: bytes, footer: dict) -> Iterator[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for at, sizes, n in footer["chunks"]:
        planes = []
        for size in sizes:
            planes.append(unpack(data[at : at + size]))
            at += size
        yield from_planes(planes, n, footer["kind"])


def read_documents(data: bytes) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(doc_id, place of its first id in the file, its ids in pieces), chunk by chunk."""
    footer = read_footer(data)
    nulls = set(footer["null_docs"])
    chunks = read_chunks(data, footer)
    block, k, start = np.zeros(0, np.uint32), 0, 0
    for i, (doc, size) in enumerate(zip(footer["docs"].tolist(), footer["sizes"].tolist(), strict=True)):
        pieces, need = [], size
        while need:
            if k == len(block):
                block, k = next(chunks), 0
            piece = block[k : k + need]
            pieces.append(piece)
            k += len(piece)
            need -= len(piece)
        yield (None if i in nulls else doc), start, pieces
        start += size


def write_ids(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", kind: str = "byte", space: Workspace | None = None) -> tuple[str, DataFrame]:
    """Encodes every text, adds END_ID, and writes files in ascending key order.

    Returns the folder of the files and the manifest (part, seq, file, n_docs,
    n_ids): the files in order of (part, seq) hold all documents in ascending
    key order (nulls first; among equal keys by a digest of the text, then as they
    come, so that rows of one key or equal rows are spread over tasks). Tasks write through
    the folder's file system under a name of their own and rename at the end,
    so a task that runs again puts the same file in place.

    Null text: empty, so END_ID alone. An empty table gives no files."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    space = space or Workspace(spark, "ids")
    folder = f"{space.path}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc = encoder(tokenizer)
        to, where = fs.FileSystem.from_uri(folder)
        to.create_dir(where, recursive=True)
        task = TaskContext.get()
        part, seq, open_, done = task.partitionId(), 0, None, []

        def close() -> None:
            nonlocal open_, seq
            w, sink, tmp, name = open_
            w.close()
            sink.close()
            to.move(tmp, f"{where}/{name}")
            done.append((part, seq, name, len(w.docs), w.n_ids))
            open_, seq = None, seq + 1

        for batch in (p for whole in batches for p in pieces_by_bytes(whole, 1)):
            for d, got in zip(batch.column(0).to_pylist(), enc.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                if open_ is None:
                    name = f"ids-{part:06d}-{seq:04d}.bp"
                    tmp = f"{where}/.{name}.{task.taskAttemptId()}"
                    sink = to.open_output_stream(tmp)
                    open_ = (FileWriter(sink, kind), sink, tmp, name)
                open_[0].add(d, np.append(got, np.uint32(END_ID)))
                if open_[0].n_ids >= FILE_IDS:
                    close()
        if open_ is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST_NAMES, x, strict=True)) for x in done], schema=_MANIFEST_ARROW)

    tie = F.xxhash64(docs[text].cast("string"))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), tie.alias("tie"), F.monotonically_increasing_id().alias("number"))
    order = ("doc_id", "tie", "number")
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return folder, space.write(ordered.mapInArrow(write, _MANIFEST), "manifest")


_MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"
_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_MANIFEST_NAMES = _MANIFEST_ARROW.names
_DOCS_ARROW = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.
    A file of at most about FILE_IDS ids and one document is read at a time."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data, file, out = content.as_py(), path.as_py().rsplit("/", 1)[-1], []
                for doc, at, pieces in read_documents(data):
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(np.ascontiguousarray(p, "<u4"), crc)
                    out.append((file, doc, at, sum(map(len, pieces)), crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _DOCS_ARROW.types, strict=True)], schema=_DOCS_ARROW)

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    docs = files.mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    # A part's files are summed in its own window; only the sums of the parts, as many as there were tasks, meet in one.
    sum_before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", sum_before(Window.orderBy("part")).alias("part_base"))
    inside = manifest.select("part", "file", sum_before(Window.partitionBy("part").orderBy("seq")).alias("file_base"))
    bases = inside.join(parts, "part").select("file", (F.col("part_base") + F.col("file_base")).alias("base"))
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
