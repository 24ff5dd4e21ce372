"""Words and word shingles of whole texts as 64-bit hashes, by array operations.

Texts are read as the bytes of an Arrow column. Nothing is kept between calls,
and what a call holds at once is a few times PIECE bytes beside its result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes whose words are hashed at once; longer words are hashed one by one, as are those over LONG bytes.
PIECE, LONG = 1 << 17, 32
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise, in a new array."""
    z = z ^ (z >> np.uint64(30))
    z *= _M1
    z ^= z >> np.uint64(27)
    z *= _M2
    z ^= z >> np.uint64(31)
    return z


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Words(NamedTuple):
    """All words of texts that lie one after another: their hashes, first bytes and
    ends, and the number of words before each text (and in all)."""

    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the place of each text in them (n + 1). Null: empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _gaps(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def _long_hash(raw: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(raw.tobytes().lower())


def byte_table(members: bytes) -> np.ndarray:
    """Of each byte, whether it is a member."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def words_of(raw: np.ndarray, at: np.ndarray, trim: np.ndarray | None = None) -> Words:
    """All words `[^\\x20\\x09-\\x0D]+` of texts; a hash is that of the word with A-Z in lower case.
    With `trim` (a byte_table) words lose such bytes at their ends; one of such bytes alone
    stays as an empty word, with a hash of 0."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = 0
    while place < len(raw):
        stop = min(place + PIECE, len(raw))
        gap = _gaps(raw[place:stop])
        if stop < len(raw):
            spaces = np.flatnonzero(gap)
            text = int(at[np.searchsorted(at, stop, "right") - 1])
            cut = max(place + int(spaces[-1]) + 1 if len(spaces) else place, text)
            if cut <= place:  # within one word
                stop = int(at[np.searchsorted(at, place, "right")])
                for k in range(place, stop, PIECE):
                    spaces = np.flatnonzero(_gaps(raw[k : min(k + PIECE, stop)]))
                    if len(spaces):
                        stop = k + int(spaces[0])
                        break
                parts.append(_giant(raw, place, stop, trim))
                place = stop
                continue
            stop = cut
        parts.append(_piece(raw[place:stop], gap[: stop - place], at, place, trim))
        place = stop
    hashes, begins, ends = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(hashes, begins, ends, np.searchsorted(begins, at))


def _giant(raw: np.ndarray, place: int, stop: int, trim: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word longer than a piece."""
    if trim is not None:
        own = np.flatnonzero(~trim[raw[place:stop]])
        place, stop = (place + int(own[0]), place + int(own[-1]) + 1) if len(own) else (place, place)
    h = mix(np.array([_long_hash(raw[place:stop])], np.uint64)) if place < stop else np.zeros(1, np.uint64)
    return h, np.array([place]), np.array([stop])


def _trimmed(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, trim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without trimmed bytes at both ends; empty ones lie at their beginning."""
    first = begins.copy()
    begins, ends = begins.copy(), ends.copy()
    on = np.flatnonzero(trim[raw[begins]])
    while len(on):
        begins[on] += 1
        on = on[begins[on] < ends[on]]
        on = on[trim[raw[begins[on]]]]
    on = np.flatnonzero((begins < ends) & trim[raw[ends - 1]])
    while len(on):
        ends[on] -= 1
        on = on[trim[raw[ends[on] - 1]]]
    empty = begins >= ends
    begins[empty] = ends[empty] = first[empty]
    return begins, ends


def _piece(raw: np.ndarray, gap: np.ndarray, at: np.ndarray, place: int, trim: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of one piece: h = sum of (byte + 1) * _BASE ** (place in the word), from running sums."""
    n = len(raw)
    cuts = at[np.searchsorted(at, place, "right") : np.searchsorted(at, place + n)] - place  # texts that begin inside
    begin, end = ~gap, ~gap
    begin[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    begin[cuts] = ~gap[cuts]
    end[cuts - 1] = ~gap[cuts - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end)
    upper = (raw - np.uint8(65)) < 26
    value = (raw + (upper.view(np.uint8) << 5)).astype(np.uint64)
    value += np.uint64(1)
    value *= _UP[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    ends += 1
    if trim is not None:
        begins, ends = _trimmed(raw, begins, ends, trim)
    h = total[ends]
    h -= total[begins]
    h *= _DOWN[begins]
    for i in np.flatnonzero(ends - begins > LONG).tolist():
        h[i] = _long_hash(raw[begins[i] : ends[i]])
    return mix(h), begins + place, ends + place


def column_words(column: pa.Array, trim: np.ndarray | None = None) -> Words:
    return words_of(*raw_texts(column), trim)


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A hash for each word of one text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes


def pieces_by_bytes(batch: pa.RecordBatch, column: int, most: int = 1 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `most` bytes of a column, or of one row."""
    if not batch.num_rows:
        return
    at = raw_texts(batch.column(column))[1]
    k = 0
    while k < batch.num_rows:
        stop = min(max(int(np.searchsorted(at, at[k] + most, "right")) - 1, k + 1), k + rows, batch.num_rows)
        yield batch.slice(k, stop - k)
        k = stop


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order; of fewer words, one for them all."""
    n = min(k, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _GOLD + words[i : len(words) - n + 1 + i])
    return h


def text_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, one text after another, and the number of each text's."""
    n = np.diff(words.firsts)
    if not len(words.hashes):
        return words.hashes, n
    own = np.repeat(np.arange(len(n)), n)
    h = np.full(max(len(words.hashes) - k + 1, 0), k, np.uint64)
    for i in range(k if len(h) else 0):
        h = mix(h * _GOLD + words.hashes[i : len(h) + i])
    inside = own[: len(h)] == own[len(words.hashes) - len(h) :]
    sizes = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(int(sizes.sum()), np.uint64)
    whole = np.repeat(n >= k, sizes)
    out[whole] = h[inside]
    starts = np.cumsum(sizes) - sizes
    for t in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[starts[t]] = shingles(words.hashes[words.firsts[t] : words.firsts[t + 1]], k)[0]
    return out, sizes
