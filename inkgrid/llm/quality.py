"""Quality rules: base rules and gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .decontam import ENDS
from .words import pieces_by_bytes

# Symbol characters, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic and the sign that the score must follow (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "distinct_share": 0,
    "digit_share": 0, "stop_share": 0, "bang_share": 0, "bar_share": -1, "top_word_share": 0, "same_next_share": -1, "words_per_line": 0,
}
#: Statistics of the words that labels show to be toxic, with the signs of the toxic score.
TOXIC = {"toxic_share": 1, "toxic_words": 1, "toxic_distinct": 1}
#: Labelled toxic rows without which no toxic model is fitted: half of them choose the
#: words and half fit the trees, and fewer say nothing of either.
LEAST_TOXIC = 30
_DELETE = {k: v.encode() for k, v in {"upper_share": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit_share": "0123456789", "stop_share": ".", "bang_share": "!", "bar_share": "|"}.items()}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup_lines = len(lines) - len(set(lines))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    seq = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    repeat = 0
    if n > 3:
        # Windows as numbers of pairs with the next word, so that any vocabulary fits.
        pairs = seq[:-1] * len(numbers) + seq[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        _, which, times = np.unique(pairs[:-1] * len(numbers) + seq[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    per = max(n, 1)
    share = {k: (len(raw) - len(raw.translate(None, v))) / max(len(raw), 1) for k, v in _DELETE.items()}
    values = {
        "log_words": np.log1p(n), "mean_word": word_chars / per, "symbol_share": symbols / max(word_chars, 1), "dup_line_share": dup_lines / max(len(lines), 1),
        "repeat_share": repeat / per, "distinct_share": len(numbers) / per, "top_word_share": np.bincount(seq).max() / n if n else 0.0,
        "same_next_share": float((seq[1:] == seq[:-1]).sum()) / per, "words_per_line": n / max(len(lines), 1), **share,
    }
    return [n, word_chars, symbols, dup_lines, repeat], [float(values[k]) for k in FEATURES]


class _Bare(dict):
    """Raw word to its bare form if that is toxic, else None. Bounded."""

    def __init__(self, toxic: frozenset[bytes]):
        super().__init__()
        self.toxic = toxic

    def __missing__(self, word: bytes) -> bytes | None:
        if len(self) > 100_000:
            self.clear()
        bare = word.strip(ENDS)
        self[word] = out = bare if bare in self.toxic else None
        return out


def _lower_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def toxic_statistics(text: str | None, bare: _Bare) -> list[float]:
    """The values of TOXIC of one whole text."""
    if not bare.toxic:
        return [0.0] * len(TOXIC)
    words = _lower_words(text)
    found = [w for w in map(bare.__getitem__, words) if w is not None]
    return [len(found) / max(len(words), 1), float(len(found)), float(len(set(found)))]


def _half() -> Column:
    """Which half of the labelled rows: 0 chooses toxic words, 1 fits the toxic trees."""
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))


def learn_words(known: DataFrame, labels: DataFrame, train_rows: int, least_docs: int = 5, least_odds: float = 1.0) -> frozenset[bytes]:
    """Words (lower case, no punctuation at their ends) that point to toxic documents,
    from half of at most `train_rows` labelled ones (doc_id, text): in `least_docs` toxic
    documents or more, with log odds of at least `least_odds` after two standard
    errors are taken off. Empty without a column `toxic` or LEAST_TOXIC toxic rows."""
    if "toxic" not in labels.columns:
        return frozenset()
    chosen = _sample(labels, "toxic", train_rows)
    texts = known.join(F.broadcast(chosen), "doc_id").withColumn("_half", _half()).select("text", (F.col("_y") > 0).alias("toxic"), "_half")
    sizes = {(r["_half"], r["toxic"]): r["count"] for r in texts.groupBy("_half", "toxic").count().collect()}
    if sizes.get((0, True), 0) + sizes.get((1, True), 0) < LEAST_TOXIC:
        return frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = list({x for x in (w.strip(ENDS) for w in _lower_words(text)) if x})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([toxic] * len(own), pa.bool_())], names=["word", "toxic"])

    a, b = F.count_if("toxic") + 0.5, F.count_if(~F.col("toxic")) + 0.5
    n = [sizes.get((0, True), 0) + 1.0, sizes.get((0, False), 0) + 1.0]
    odds = F.log(a / n[0]) - F.log(b / n[1]) - 2 * F.sqrt(1 / a + 1 / b)
    words = texts.where("_half = 0").select("text", "toxic").mapInArrow(run, "word binary, toxic boolean").groupBy("word")
    found = words.agg(odds.alias("odds"), F.count_if("toxic").alias("docs")).where((F.col("docs") >= least_docs) & (F.col("odds") >= least_odds))
    return frozenset(bytes(r.word) for r in found.select("word").collect())


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", toxic: frozenset[bytes] = frozenset()) -> DataFrame:
    """doc_id, COUNTS, FEATURES and TOXIC of every row. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = _Bare(toxic)
        for b in (p for batch in batches for p in pieces_by_bytes(batch, 1)):
            keys, texts = b.column(0), b.column(1).to_pylist()
            got = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
            values = np.array([v for _, v in got], np.float64).reshape(-1, len(FEATURES))
            said = np.array([toxic_statistics(t, bare) for t in texts], np.float64).reshape(-1, len(TOXIC))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x) for v in (counts, values, said) for x in v.T.copy())], names=["doc_id", *COUNTS, *FEATURES, *TOXIC])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in (*FEATURES, *TOXIC))])
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


@dataclass
class Trees:
    """All trees in flat node arrays. A leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row; nodes of all rows step down together."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosts regression trees on the logistic loss, by histograms of quantile bins.

    On a feature with a sign, a split must order its children's values by it,
    and their mean bounds the values of all nodes below on either side; so the
    score is monotonic in that feature whatever the others are."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = np.log(p / (1 - p))
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]
    logit = np.full(len(y), base)

    def node(v: float) -> int:
        n = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(n)
        right.append(n)
        value.append(v)
        return n

    def grow(rows: np.ndarray, lo: float, hi: float, level: int, g: np.ndarray, h: np.ndarray) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = node(rate * float(np.clip(total_g / (total_h + ridge), lo, hi)))
        best = (1e-6, None)
        if level:
            for f, (e, b, sign) in enumerate(zip(edges, binned, signs, strict=True)):
                if not len(e):
                    continue
                at = b[rows]
                sg, sh, sn = (np.bincount(at, w, len(e) + 1)[:-1].cumsum() for w in (g[rows], h[rows], None))
                lv, rv = np.clip(sg / (sh + ridge), lo, hi), np.clip((total_g - sg) / (total_h - sh + ridge), lo, hi)
                gain = lambda v, a, b_: v * a - 0.5 * v * v * (b_ + ridge)
                won = gain(lv, sg, sh) + gain(rv, total_g - sg, total_h - sh) - gain(np.clip(total_g / (total_h + ridge), lo, hi), total_g, total_h)
                ok = (sn >= least) & (len(rows) - sn >= least)
                if sign:
                    ok &= (rv - lv) * sign >= 0
                won = np.where(ok, won, -np.inf)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], (f, k, sign, lv[k], rv[k]))
        if best[1] is None:
            logit[rows] += value[own]
            return own
        f, k, sign, lv, rv = best[1]
        mid = (lv + rv) / 2
        feature[own], threshold[own] = f, float(edges[f][k])
        goes = binned[f][rows] <= k
        left[own] = grow(rows[goes], max(lo, mid) if sign < 0 else lo, min(hi, mid) if sign > 0 else hi, level - 1, g, h)
        right[own] = grow(rows[~goes], max(lo, mid) if sign > 0 else lo, min(hi, mid) if sign < 0 else hi, level - 1, g, h)
        return own

    if 0 < y.sum() < len(y):
        for _ in range(n_trees):
            q = 1 / (1 + np.exp(-logit))
            roots.append(grow(np.arange(len(y)), -4.0, 4.0, depth, y - q, q * (1 - q)))
    return Trees(*(np.array(a, t) for a, t in ((feature, int), (threshold, float), (left, int), (right, int), (value, float), (roots, int))), depth, base)


def _sample(labels: DataFrame, target: str, rows: int, key: str = "doc_id") -> DataFrame:
    return labels.select(labels[key].cast("long").alias("doc_id"), labels[target].cast("int").alias("_y")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)


def _at_most(known: DataFrame, rows: int) -> DataFrame:
    """Twice `rows` labelled documents at most, by a hash of their statistics: a labelled key may be on many documents."""
    return known.orderBy(F.xxhash64("doc_id", *COUNTS), "doc_id", *COUNTS).limit(2 * rows)


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", target: str = "quality", train_rows: int = 20_000) -> Trees | None:
    """Trees fitted on at most `train_rows` labels, those with the least hash of their
    key, and at most twice as many documents. None if the labels don't have both classes."""
    chosen = _sample(labels, target, train_rows, key)
    got = _at_most(stats.join(chosen, "doc_id"), train_rows).select("_y", *FEATURES).toPandas()
    y = (got["_y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    order = np.lexsort(got.to_numpy().T)  # sums in one order whatever the partitions
    return fit_trees(got[list(FEATURES)].to_numpy(float)[order], y[order], list(FEATURES.values()))


def train_toxic(stats: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> Trees | None:
    """Trees for the label `toxic` over TOXIC, fitted on the half of the labelled rows
    that didn't choose the words. None if that half doesn't have both classes."""
    chosen = _sample(labels, "toxic", train_rows).where(_half() == 1)
    got = _at_most(stats.join(chosen, "doc_id"), train_rows).select("_y", *TOXIC).toPandas()
    y = (got["_y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    order = np.lexsort(got.to_numpy().T)
    return fit_trees(got[list(TOXIC)].to_numpy(float)[order], y[order], list(TOXIC.values()))


def _verdict(x: np.ndarray, counts: dict[str, np.ndarray], model: Trees | None, least_words: int, most_repeat_percent: int, least_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept) of rows; without a model the score is infinite."""
    failed = (counts["n_words"] < least_words) | (100 * counts["n_repeat_words"] > most_repeat_percent * counts["n_words"])
    score = model.score(x) if model else np.full(len(x), np.inf)
    return failed, score, ~failed & (score >= np.log(least_score / (1 - least_score)))


def _odds_toxic(x: np.ndarray, model: Trees | None) -> np.ndarray:
    """The log odds of toxic of rows; without a model minus infinity."""
    return model.score(x) if model else np.full(len(x), -np.inf)


def judge(stats: DataFrame, model: Trees | None, least_words: int = 50, most_repeat_percent: int = 50, least_score: float = 0.5, toxic_model: Trees | None = None) -> DataFrame:
    """doc_id, COUNTS, base_failed, score (probability of quality; null without a model),
    kept, toxic_score (probability of toxic, from 0.5 not kept; null without a model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in FEATURES])
            counts = {c: b.column(c).to_numpy() for c in COUNTS}
            failed, score, kept = _verdict(x, counts, model, least_words, most_repeat_percent, least_score)
            prob = pa.array(1 / (1 + np.exp(-score)), mask=np.full(len(x), model is None))
            bad = _odds_toxic(np.column_stack([b.column(c).to_numpy() for c in TOXIC]), toxic_model)
            said = pa.array(1 / (1 + np.exp(-bad)), mask=np.full(len(x), toxic_model is None))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in COUNTS), pa.array(failed), prob, pa.array(kept & (bad < 0)), said], names=["doc_id", *COUNTS, "base_failed", "score", "kept", "toxic_score"])

    return stats.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, score double, kept boolean, toxic_score double"]))


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, train_rows: int) -> DataFrame:
    """(doc_id, text) of the documents that the fits read."""
    targets = [t for t in ("quality", "toxic") if t in labels.columns]
    ids = [_sample(labels, t, train_rows).select("doc_id") for t in targets]
    chosen = (ids[0].union(ids[1]) if len(ids) > 1 else ids[0]).distinct()
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = 20_000, least_words: int = 50, most_repeat_percent: int = 50, least_score: float = 0.5) -> DataFrame:
    """The documents that judge_quality keeps, with all their columns, in one pass
    after the fit; the fit reads the documents of at most `train_rows` labels. Each row is judged
    by its own text, whatever its key: null and empty texts go, equal rows stay or go
    together. An empty table stays empty; without labels the base rules alone decide."""
    known = _labelled(docs, labels, key, text, train_rows)
    words = learn_words(known, labels, train_rows)
    stats = Workspace(docs.sparkSession, "quality").write(document_statistics(known, toxic=words), "stats")
    model = train(stats, labels, train_rows=train_rows)
    toxic_model = train_toxic(stats, labels, train_rows) if words else None
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = _Bare(words)
        for b in (p for batch in batches for p in pieces_by_bytes(batch, at)):
            texts = b.column(at).to_pylist()
            got = [statistics(t) for t in texts]
            counts = dict(zip(COUNTS, np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS)).T, strict=True))
            x = np.array([v for _, v in got], np.float64).reshape(-1, len(FEATURES))
            kept = _verdict(x, counts, model, least_words, most_repeat_percent, least_score)[2]
            said = np.array([toxic_statistics(t, bare) for t in texts], np.float64).reshape(-1, len(TOXIC))
            yield b.filter(pa.array(kept & (_odds_toxic(said, toxic_model) < 0)))

    return docs.mapInArrow(run, docs.schema)


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = 20_000) -> DataFrame:
    """Statistics of every document, trees fitted on labelled ones, and verdicts.

    Null and empty text: no words, so base_failed. Equal rows are each judged;
    a key with several labels counts once for each. Without labels of both
    classes the base rules alone decide. Where labels have a column `toxic`, and
    LEAST_TOXIC toxic rows, documents that words show to be toxic are not kept.
    Other columns are not read."""
    space = Workspace(docs.sparkSession, "quality")
    words = learn_words(_labelled(docs, labels, key, text, train_rows), labels, train_rows)
    stats = space.write(document_statistics(docs, key, text, words), "stats")
    toxic_model = train_toxic(stats, labels, train_rows) if words else None
    return judge(stats, train(stats, labels, train_rows=train_rows), toxic_model=toxic_model)
