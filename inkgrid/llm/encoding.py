"""Exact byte-level BPE encoding by word, with a bounded cache per Python worker.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each alone.
So each distinct pre-token goes through the tokenizers library once, and texts
are put together from the cached ids. Texts with characters on which Unicode
versions may disagree go through the library whole."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The pre-token pattern of the byte-level tokenizer, in the classes
# of Python's re module; equal to the tokenizer's for the characters of PLAIN.
PRE_TOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
# Characters whose class is the same in all Unicode versions in use
# (without superscript digits and fractions, which re counts as letters).
PLAIN = r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-˿Ѐ-ԯ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]*"
#: Characters of a slice of a very long text.
SLICE = 1 << 20


# The printable byte alphabet of byte-level tokenizers: bytes that print stand for
# themselves, the others for the characters from 256 on, in order.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


class _Words(dict):
    """Pre-token to its number; a new one is numbered and noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, path: str, cache_words: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Added tokens are cut out before words are: texts with one go through the library whole.
        self.marks = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.split = re.compile(PRE_TOKEN).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.cut = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        """Forgets all words: of some 20 bytes each, they and their ids take about 50 MB at most."""
        self.words = _Words()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.known = self.used = 0

    def _learn(self) -> None:
        """Encodes the new words by the tokenizer's BPE model, in its byte alphabet."""
        new, self.words.new = self.words.new, []
        tokenize, table = self.tokenizer.model.tokenize, _BYTES
        got = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(table))] for w in new]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(got) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        to = slice(self.known, self.known + len(got))
        self.sizes[to] = sizes
        self.starts[to] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        self.known += len(got)
        self.used += total

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            m = self.cut(text, at + SLICE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _plain_ids(self, text: str) -> np.ndarray:
        numbers = np.fromiter(map(self.words.__getitem__, self.split(text)), np.int64)
        if self.words.new:
            self._learn()
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint32)
        return self.ids[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])]

    def _simple(self, text: str) -> bool:
        return bool(self.by_word and not any(m in text for m in self.marks) and self.plain(text))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; a slice of a long one at a time."""
        if not self._simple(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        out = []
        for part in self._slices(text):
            if len(self.words) > self.cache_words:
                self._clear()
            out.append(self._plain_ids(part))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of many texts. The words of a few MB of texts are learnt at once."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[tuple[int, str]] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > SLICE or not self._simple(t):
                out[i] = self.encode(t)
                continue
            group.append((i, t))
            size += len(t)
            if size > SLICE:
                self._group(group, out)
                group, size = [], 0
        self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, str]], out: list) -> None:
        if not group:
            return
        if len(self.words) > self.cache_words:
            self._clear()
        get = self.words.__getitem__
        numbers = [np.fromiter(map(get, self.split(t)), np.int32) for _, t in group]
        counts = [len(x) for x in numbers]
        if self.words.new:
            self._learn()
        if not sum(counts):
            for i, _ in group:
                out[i] = np.zeros(0, np.uint32)
            return
        n = np.concatenate(numbers)
        sizes = self.sizes[n]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[n] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        for k, (i, _) in enumerate(group):
            out[i] = ids[cuts[k] : cuts[k + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks. Only one is kept."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
