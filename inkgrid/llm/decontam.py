"""Benchmark decontamination: n-gram seeds, a score bound, then Smith-Waterman alignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .words import byte_table, column_words, mix, pieces_by_bytes, _GOLD

#: Words of the items that are searched for in one pass; more go in further passes.
PASS_WORDS = 2_000_000
# Punctuation that is no part of a word's ends; alignment scores.
ENDS = b".,;:!?\"'()[]{}<>*#$%&|"
MATCH, MISMATCH, GAP = 2, -1, -1


_TRIM = byte_table(ENDS)
#: Bits of the map that says which grams may be seeds.
MAP_BITS = 22


def bare_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, one text after another: hashes of their bare forms (lower
    case, no punctuation at their ends), their numbers among all words of their text, and
    how many lie before each text. Bare punctuation is no word, but is counted in the numbers."""
    try:
        column = pc.utf8_lower(column)
    except pa.ArrowInvalid:  # no valid UTF-8: A-Z only
        pass
    w = column_words(column, _TRIM)
    number = np.arange(len(w.hashes)) - np.repeat(w.firsts[:-1], np.diff(w.firsts))
    on = np.flatnonzero(w.begins < w.ends)
    return w.hashes[on], number[on], np.searchsorted(on, w.firsts)


def _grams(seq: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(len(seq) - n + 1, 0), n, np.uint64)
    for i in range(n if len(h) else 0):
        h = mix(h * _GOLD + seq[i : len(h) + i])
    return h


class Items:
    """The items of one pass: the hashes of their words, and where each n-gram is. An
    item of fewer than n words is one gram of them all."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int):
        words, _, firsts = bare_words(pa.array([text for _, text in rows], pa.string()))
        places = defaultdict(list)
        self.ids = [item for item, _ in rows]
        self.seqs = [words[a:z] for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
        for i, seq in enumerate(self.seqs):
            for at, g in enumerate(_grams(seq, min(n, len(seq))).tolist() if len(seq) else []):
                places[g].append((i, at))
        self.sizes = sorted({min(n, len(seq)) for seq in self.seqs if len(seq)})
        self.words = [np.unique(seq, return_counts=True) for seq in self.seqs]
        self.grams = np.array(sorted(places), np.uint64)
        self.places = [places[g] for g in self.grams.tolist()]
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - MAP_BITS)).astype(np.int64)

    def hits(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which an n-gram of an item begins, and which one."""
        at, which = [], []
        for size in self.sizes:
            g = _grams(seq, size)
            on = np.flatnonzero(self.map[self._slot(g)])
            k = np.searchsorted(self.grams, g[on])
            k[k == len(self.grams)] = 0
            ok = self.grams[k] == g[on]
            at.append(on[ok])
            which.append(k[ok])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def most_common(words: tuple[np.ndarray, np.ndarray], passage: np.ndarray) -> int:
    """The words (distinct ones, their counts) that a passage has too, each as often
    as both have it. No alignment of the two has more matches."""
    own, times = words
    k = np.searchsorted(own, passage)
    k[k == len(own)] = 0
    return int(np.minimum(np.bincount(k[own[k] == passage], minlength=len(own)), times).sum())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score of a passage against an item, and where it ends in the
    passage (after its last word). Rows go over the item; a gap along the row is
    a running maximum."""
    slope = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        step = np.maximum(row + GAP, 0)
        np.maximum(step[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH), out=step[1:])
        row = np.maximum.accumulate(step + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int64()), ("most", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def _search(items: Items, n: int, percent: int):
    """A function for mapInArrow: the best aligned passage of each (document, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_by_bytes(batch, 1):
                words, number, firsts = bare_words(b.column(1))
                at, gram = items.hits(words)
                text = np.searchsorted(firsts, at, "right") - 1
                size = np.array([min(n, len(s)) for s in items.seqs])
                out = []
                order = np.lexsort((at, text))
                for own in np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if len(order) else []:
                    t = int(text[own[0]])
                    doc, first, seq = b.column(0)[t].as_py(), int(firsts[t]), words[firsts[t] : firsts[t + 1]]
                    spans = windows_of((at[own] - first).tolist(), gram[own].tolist(), len(seq), size)
                    out += [(doc, *r[:3], int(number[first + r[3]]), int(number[first + r[4] - 1]) + 1) for r in best_passages(seq, spans)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    def windows_of(at: list[int], gram: list[int], total: int, gram_size: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The windows of each item that seeds open; overlapping ones are one."""
        windows = defaultdict(list)
        for p, g in zip(at, gram, strict=True):
            for item, offset in items.places[g]:
                if p + gram_size[item] > total:  # the gram goes on into the next text
                    continue
                size = len(items.seqs[item])
                slack = size // 4 + 5
                spans, lo, hi = windows[item], max(p - offset - slack, 0), p - offset + size + slack
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        return windows

    def best_passages(seq: np.ndarray, windows: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, score, most, begin, end) of the items whose best passage scores enough."""
        for item, spans in windows.items():
            own, best = items.seqs[item], (0, 0, 0)
            for lo, hi in spans:
                passage = seq[lo:hi]
                if 100 * most_common(items.words[item], passage) < percent * len(own):
                    continue
                score, end = align(own, passage)
                if score > best[0]:
                    best = (score, lo, lo + end)
            score, lo, end = best
            if score and 100 * score >= percent * MATCH * len(own):
                _, back = align(own[::-1], seq[lo:end][::-1])
                yield items.ids[item], score, MATCH * len(own), end - back, end

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 3, often: int = 50, percent: int = 50) -> DataFrame:
    """A row for each (document, item) whose best alignment reaches `percent` of
    the item's own score: doc_id, item_id, score, most, start_word, end_word.

    Words are split at ASCII white space, in lower case, without
    punctuation at their ends; bare punctuation is no word on either side. All n-grams of the items are seeds, however often
    the corpus has them. Each seed in a document opens
    a window the size of the item and a quarter more on both sides; overlapping
    windows of an item are one. Windows whose words in common with the item allow
    the score are aligned by Smith-Waterman with word
    matches of 2, mismatches and gaps of -1. Items of more than PASS_WORDS words
    in all go in several passes over the documents, so what each task holds is bounded.

    Null texts have no words. Of an item of fewer than n words all of them are the one
    seed, so a passage has them in a row. Start and end are numbers of words at white space. Rows
    that share a doc_id are searched each. Empty tables give an empty result.
    Other columns are not read.

    `often` has no effect: it was a limit on the counts of seeds, and callers still give it."""
    space = Workspace(docs.sparkSession, "leaks")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    tests = benchmark.select(benchmark[item_key].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text"))
    words = tests.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")))).first()[0] or 0
    passes = -(-words // PASS_WORDS)
    found = []
    for k in range(passes):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        items = Items(sorted((tuple(r) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), n)
        search = _search(items, n, percent)
        found.append(space.write(rows.mapInArrow(search, "doc_id long, item_id long, score long, most long, start_word long, end_word long"), f"found-{k}"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score long, most long, start_word long, end_word long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
