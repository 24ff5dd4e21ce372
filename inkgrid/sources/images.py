"""Ruled lines in page images: ink by a local threshold, then long runs of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Side and offset of the local threshold, least length of a line in inches.
WINDOW, OFFSET, LEAST_INCHES = 15, 5, 0.5
_LINES = pa.schema([("page", pa.int64()), ("orientation", pa.string()), ("axis", pa.float64()), ("start", pa.float64()), ("stop", pa.float64()), ("confidence", pa.float64())])


def ink(gray: np.ndarray) -> np.ndarray:
    """Pixels darker than the mean of the window about them by more than the offset; the
    image goes on beyond its edges as it ends there."""
    half = WINDOW // 2
    wide = np.pad(gray.astype(np.int64), half, mode="edge")
    total = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    mean = (total[WINDOW:, WINDOW:] - total[:-WINDOW, WINDOW:] - total[WINDOW:, :-WINDOW] + total[:-WINDOW, :-WINDOW]) / WINDOW**2
    return gray < mean - OFFSET


def long_runs(mask: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """Boxes (first row, end row, first column, end column) about runs of at least `least` ink
    pixels in a row, those of neighbouring rows that overlap in one."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begins = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    on = ends - begins >= least
    boxes: list[list[int]] = []
    for r, a, z in zip(rows[on].tolist(), begins[on].tolist(), ends[on].tolist(), strict=True):
        near = next((b for b in reversed(boxes) if b[1] == r and a < b[3] and z > b[2]), None)
        if near is None:
            boxes.append([r, r + 1, a, z])
        else:
            near[1:] = r + 1, min(a, near[2]), max(z, near[3])
    return [tuple(b) for b in boxes]


def detect_lines(images: DataFrame, dpi: float) -> DataFrame:
    """The lines of grey images (page, width, height, pixels: a byte each) of a resolution, in
    pixels of the image. An image whose size doesn't fit its bytes has none."""
    least = LEAST_INCHES * dpi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in range(b.num_rows):  # one image at a time: a batch may have many
                page, w, h, pixels = (c[at].as_py() for c in b.columns)
                if not pixels or len(pixels) != w * h:
                    continue
                mask = ink(np.frombuffer(pixels, np.uint8).reshape(h, w))
                for kind, m in (("horizontal", mask), ("vertical", mask.T)):
                    out += [(page, kind, (a + z) / 2, float(x), float(y), 1.0) for a, z, x, y in long_runs(m, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LINES.types, strict=True)], schema=_LINES)

    return images.select("page", "width", "height", "pixels").mapInArrow(run, "page long, orientation string, axis double, start double, stop double, confidence double")
