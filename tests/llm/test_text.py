"""Quality rules, line dedup, near-dedup, passages, decontamination against plain models."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import decontam, linededup, neardup, passages, quality
from inkgrid.llm.common import Workspace
from inkgrid.llm.components import components

from .helpers import SCHEMA, edge_docs, empty, prose, with_clashes, words
from .helpers import components as plain_components


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


# --- quality ------------------------------------------------------------------------
def base(text):
    w = words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(three)
    covered = {i + k for i, t in enumerate(three) if times[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return [len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_base_counts(spark):
    rnd = random.Random(1)
    texts = [r.text for r in edge_docs(spark).collect()] + ["".join(rnd.choice("ab \n#é|") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert quality.statistics(t)[0] == base(t)


def test_trees_are_monotonic_and_learn():
    rnd = np.random.default_rng(2)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rnd.standard_normal(3000) < 0.5) ^ (x[:, 1] > 0.9)).astype(float)
    t = quality.fit_trees(x, y, [-1, 0, 0], n_trees=40)
    for _ in range(50):
        a = np.repeat(rnd.random((1, 3)), 50, 0)
        a[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(t.score(a)) <= 1e-12).all()
    free = quality.fit_trees(x, y, [0, 0, 0], n_trees=40)
    assert (((free.score(x) > 0) == y).mean()) > 0.78
    one = quality.fit_trees(x, np.ones(3000), [0, 0, 0])
    assert (one.score(x) > 0).all()


def test_scores_equal_a_plain_walk():
    rnd = np.random.default_rng(22)
    x = rnd.random((800, 4))
    t = quality.fit_trees(x, (x[:, 0] + x[:, 1] > 1).astype(float), [1, 0, 0, 0], n_trees=15)

    def walk(row):
        total = t.base
        for node in t.roots.tolist():
            while t.left[node] != node:
                node = int(t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node])
            total += t.value[node]
        return total

    assert np.allclose(t.score(x), [walk(r) for r in x])


def test_held_out_accuracy(spark):
    """Fitted on the labels with even ids of sf0.01, judged on the odd ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels.where("doc_id % 2 = 0").drop("toxic")).collect()}
    known = [r for r in labels.where("doc_id % 2 = 1").collect() if not got[r.doc_id].base_failed]
    assert len(known) > 100 and np.mean([got[r.doc_id].kept == (r.quality == 1) for r in known]) > 0.95


def test_quality_verdicts(spark):
    rnd = random.Random(3)
    good = [(200 + i, prose(rnd, 120)) for i in range(60)]
    bad = [(300 + i, " ".join(f"w{rnd.randint(0, 999)}###" for _ in range(120))) for i in range(60)]
    docs = docs_of(spark, good + bad).unionByName(edge_docs(spark))
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:40]] + [(i, 0) for i, _ in bad[:40]] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge_quality(with_clashes(docs), labels).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad)
    assert got[1].base_failed and got[9].base_failed and got[1].n_words == 0
    kept = quality.keep_quality(with_clashes(docs), labels)
    assert kept.columns == with_clashes(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in good}
    none = quality.judge_quality(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.score is None for r in none)
    assert quality.judge_quality(empty(spark), labels).count() == 0


def test_toxic_documents_go(spark):
    rnd = random.Random(18)
    rows = []
    for i in range(240):
        w = prose(rnd, 120, 600).split()
        if i % 3 == 0:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Scum,", "trash.", "(moron)", "idiot"]))
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(180)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    clean = {i for i in range(240) if i % 3}
    assert {r.doc_id for r in quality.judge_quality(docs, labels).where("kept").collect()} == clean
    assert {r.doc_id for r in quality.keep_quality(docs, labels).collect()} == clean
    few = labels.where("toxic = 0 or doc_id < 60")  # too few toxic rows to learn from
    assert quality.keep_quality(docs, few).count() == 240


# --- line dedup -----------------------------------------------------------------------
def line_model(rows, percent=80, least=5):
    first, lines = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, x in enumerate((t or "").split("\n")):
            s = frozenset(words(re.sub("[A-Z]", lambda m: m[0].lower(), x)))
            if len(s) >= least:
                lines.append((d, k, s))
                first.setdefault(s, (d, k))
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    near = {s: [o for o in first if o != s and 100 * len(s & o) >= percent * len(s | o)] for s in first}
    out = {}
    for d, k, s in lines:
        e = min([first[s], *(first[o] for o in near[s])], key=key)
        out[d, k] = (len(s), len(near[s]), first[s], e, key((d, k)) > key(e))
    return out


def test_lines_equal_model(spark):
    rnd = random.Random(4)
    base_lines = [prose(rnd, rnd.randint(4, 40), 300) for _ in range(40)]

    def edit(x):
        w = x.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"w{rnd.randint(0, 300)}"
        return " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)

    rows = [(i, "\n".join(edit(rnd.choice(base_lines)) for _ in range(6))) for i in range(60)] + [(200, None), (201, ""), (None, base_lines[0]), (202, "a b c d\n" * 3)]
    docs = docs_of(spark, rows)
    for percent in (80, 60, 100):
        lines = linededup.join_lines(with_clashes(docs), percent=percent)
        got = {(r.doc_id, r.line_no): (r.n_tokens, r.n_links, (r.class_doc_id, r.class_line_no), (r.first_doc_id, r.first_line_no), r.removed) for r in lines.collect()}
        want = line_model(rows, percent)
        assert got == want
    lines = linededup.join_lines(docs)
    kept = {r.doc_id: r.text for r in linededup.drop_lines(docs, lines).collect()}
    want = line_model(rows)
    for d, t in rows:
        own = {k: v for (x, k), v in want.items() if x == d}
        left = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not (k in own and own[k][-1]))
        if left != t and not words(left):
            assert d not in kept
        else:
            assert kept[d] == left


def test_lines_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SIDE", 5)
    rnd = random.Random(14)
    hub = [prose(rnd, 40) for _ in range(2)]

    def edit(x):
        w = x.split()
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(40)] = f"x{rnd.randint(0, 9**9)}"
        return " ".join(w)

    rows = [(i, "\n".join(edit(x) for x in hub)) for i in range(60)]
    got = {(r.doc_id, r.line_no): (r.n_tokens, r.n_links, (r.class_doc_id, r.class_line_no), (r.first_doc_id, r.first_line_no), r.removed) for r in linededup.join_lines(docs_of(spark, rows)).collect()}
    assert got == line_model(rows)


def test_lines_of_edge_docs(spark):
    lines = linededup.join_lines(with_clashes(edge_docs(spark)))
    assert {(r.doc_id, r.removed) for r in lines.collect()} == {(10, False), (10, True)}
    assert linededup.join_lines(empty(spark)).count() == 0
    out = linededup.drop_lines(with_clashes(edge_docs(spark)), lines)
    assert out.count() == edge_docs(spark).count() and out.columns == with_clashes(edge_docs(spark)).columns


def test_sets_of_long_lines_are_sent_for_near_pairs_alone(spark, monkeypatch):
    """Long lines with some rare words in common are no pairs; all pairs of alike lines meet at one place."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"a{j}" for j in rng.choice(400, 160, replace=False))) for i in range(30)]
    base_line = [f"b{j}" for j in range(100)]
    rows += [(100 + i, " ".join(f"c{i}" if j == i else w for j, w in enumerate(base_line))) for i in range(20)]
    rows += [(200 + i, " ".join(f"d{rng.integers(40)}" for _ in range(400))) for i in range(3)]
    written, write = {}, linededup.Workspace.write

    def kept(self, df, name, *rest):
        out = write(self, df, name, *rest)
        written[name] = out.count()
        return out

    monkeypatch.setattr(linededup.Workspace, "write", kept)
    got = {r.doc_id: r.n_links for r in linededup.join_lines(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(30)] == [0] * 30
    assert [got[100 + i] for i in range(20)] == [19] * 20
    assert written["sets"] < 30


def test_line_drop_takes_any_column_names(spark):
    names = ("_gone", "_left", "_text", "_doc", "_row", "_GONE_", "doc", "row", "line_no", "removed", "row_key")
    rows = [(1, "a b c d e f\nshort one"), (2, "short two\nA b c d e f"), (3, "a b c d e f\n\t"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    out = linededup.drop_lines(docs, linededup.join_lines(docs))
    assert out.columns == docs.columns
    # A document keeps its short lines, and goes only if no word is left.
    assert {(r.doc_id, r.text, r._gone) for r in out.collect()} == {(1, rows[0][1], "own _gone"), (2, "short two", "own _gone"), (None, None, "own _gone")}


def test_hot_prefix_tokens(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GROUP", 3)
    monkeypatch.setattr(linededup, "ROWS", 40)
    monkeypatch.setattr(linededup, "SIDE", 4)
    rnd = random.Random(21)
    rows = [(i, "\n".join(prose(rnd, rnd.randint(4, 12), 14) for _ in range(4))) for i in range(60)]
    got = {(r.doc_id, r.line_no): (r.n_tokens, r.n_links, (r.class_doc_id, r.class_line_no), (r.first_doc_id, r.first_line_no), r.removed) for r in linededup.join_lines(docs_of(spark, rows), least=1).collect()}
    assert got == line_model(rows, least=1)


@pytest.mark.parametrize("d", [None, 7])
def test_lines_go_only_from_their_own_row(spark, d):
    rnd = random.Random(17)
    line = [prose(rnd, 12, 10**6) for _ in range(8)]
    rows = [(d, "\n".join(line[:3])), (d, "\n".join([line[3], line[0], line[4]])), (d, "\n".join([line[0], line[5], line[6]])), (d, line[7])]
    docs = docs_of(spark, rows)
    out = [r.text for r in linededup.drop_lines(docs, linededup.join_lines(with_clashes(docs))).collect()]
    assert len(out) == 4 and Counter(x for t in out for x in t.split("\n")) == Counter(line)


# --- near-dedup -----------------------------------------------------------------------
def shingle_set(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def near_model(rows, k, percent=80):
    sets = {d: shingle_set(t, k) for d, t in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, plain_components(ids, links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_model(spark, k):
    rnd = random.Random(k)
    rows = [(i, prose(rnd, rnd.randint(1, 200))) for i in range(60)]

    def edit(t, share):
        return " ".join(f"x{rnd.randint(0, 9**9)}" if rnd.random() < share else w for w in t.split())

    hub = prose(rnd, 300)
    # Copies of a missing text, near the threshold with each other; and chains of edits.
    rows += [(1000 + i, edit(hub, 0.15 / k * rnd.random())) for i in range(60)]
    chain = prose(rnd, 200)
    for i in range(30):
        chain = edit(chain, 0.02)
        rows.append((2000 + i, chain))
    rows += [(3000 + i, rows[5][1]) for i in range(20)] + [(4000, None), (4001, ""), (4002, "one"), (4003, "ONE"), (None, "one")]
    rnd.shuffle(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(with_clashes(docs_of(spark, rows)), shingle=k).collect()}
    sets, want = near_model(rows, k)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items() if d is not None} == {d: (len(sets[d]), c, c == d) for d, c in want.items()}
    assert got[None].component_id is None and got[None].kept


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    test_near_duplicates_equal_model(spark, 2)


def test_near_duplicates_of_edge_docs(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(edge_docs(spark), shingle=2).collect()]
    assert len(got) == edge_docs(spark).count()
    assert {(5, 1, 4, False), (4, 1, 4, True), (7, 1, 6, False), (1, 0, 1, True), (9, 1, 9, True)} <= set(got)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_super_minhash_estimates():
    rnd = np.random.default_rng(7)
    for n in (1, 3, 40, 700):
        a = rnd.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: int(n * 0.7)], rnd.integers(0, 2**63, n - int(n * 0.7), dtype=np.uint64)])
        x = np.concatenate([a, b, a[::-1]])
        s = neardup.super_minhash(x, np.repeat(np.arange(3), n), 3, 240)
        assert (s[0] == s[2]).all() and np.isfinite(s).all()
        truth = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((s[0] == s[1]).mean() - truth) < 0.12


def test_components_equal_model(spark):
    rnd = random.Random(8)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {r.u: r.v for r in components(df, Workspace(spark, "t"), "c").collect()}
    want = plain_components(sorted({x for p in links for x in p}), links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(df.limit(0), Workspace(spark, "t"), "c").count() == 0


# --- passages -------------------------------------------------------------------------
def test_windows_equal_plain_minima():
    rnd = np.random.default_rng(9)
    items = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    items[100:200] = items[100]  # a run of equal items
    owner = np.repeat([0, 1, 2], [150, 200, 50])
    h, c, a, z = passages.compact_windows(items, owner, 0, 20)
    got = {s: int(x) for x, i, k in zip(h, a, z, strict=True) for s in range(i, k + 1)}
    full = passages.mix(items + np.uint64(0x632BE59BD9B4E019))
    want = {s: int(full[s : s + 20].min()) for s in range(400 - 19) if owner[s] == owner[s + 19]}
    assert got == want
    assert (full[c] == h).all()


def test_passages(spark):
    rnd = random.Random(10)
    shared, other = prose(rnd, 70), prose(rnd, 60)
    edited = other.split()
    edited[30] = "changed"
    rows = [(i, prose(rnd, 150)) for i in range(20)]
    rows[3] = (3, f"{prose(rnd, 40)} {shared} {prose(rnd, 10)}")
    rows[9] = (9, f"{shared.upper()}\n{prose(rnd, 90)}")
    rows[11] = (11, f"{prose(rnd, 90)} {' '.join(shared.split()[:40])}")  # too short to count
    rows[12] = (12, f"{prose(rnd, 33)} {other}")
    rows[15] = (15, f"{' '.join(edited)} {prose(rnd, 20)}")
    rows += [(30 + i, f"{prose(rnd, 5)} {shared}") for i in range(25)] + [(80, None), (None, shared), (81, "word " * 200), (82, "word " * 90)]
    got = passages.repeated_passages(with_clashes(docs_of(spark, rows))).collect()
    pairs = {(r.doc_id, r.source_doc_id) for r in got}
    assert {(9, 3), (15, 12), (82, 81)} | {(30 + i, 3) for i in range(25)} == pairs
    r = next(r for r in got if r.doc_id == 9)
    assert (r.start_word, r.source_start_word) == (0, 40) and 70 <= r.end_word <= 76
    assert passages.repeated_passages(empty(spark)).count() == 0
    assert passages.repeated_passages(edge_docs(spark)).count() == 0


def test_passages_of_lines_that_occur_singly_before(spark):
    rnd = random.Random(19)
    rows = []
    for case in range(12):
        lines = [prose(rnd, 10, 10**6) for _ in range(7)]
        at = 100 * case
        rows += [(at + i, f"{prose(rnd, 60, 10**6)} {x} {prose(rnd, 60, 10**6)}") for i, x in enumerate(lines)]
        rows += [(at + 50 + i, f"{prose(rnd, 30, 10**6)} {' '.join(lines)} {prose(rnd, 30, 10**6)}") for i in range(2)]
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs_of(spark, rows)).collect()}
    assert got == {(100 * case + 51, 100 * case + 50) for case in range(12)}


def test_partial_quotes_in_earlier_documents(spark):
    """Each pair has an earlier document with 40 of the 50 words; or with both halves of 60 words apart."""
    rnd = random.Random(23)
    rows, want = [], set()
    for case in range(30):
        at = 10 * case
        p, q = prose(rnd, 50, 10**6).split(), prose(rnd, 60, 10**6).split()
        rows.append((at, f"{prose(rnd, 40, 10**6)} {' '.join(p[:40])} {prose(rnd, 40, 10**6)}"))
        rows.append((at + 1, f"{' '.join(q[:30])} {prose(rnd, 40, 10**6)} {' '.join(q[30:])}"))
        for i, words_ in ((2, p), (4, q)):
            rows += [(at + i + k, f"{prose(rnd, 30, 10**6)} {' '.join(words_)} {prose(rnd, 30, 10**6)}") for k in range(2)]
            want.add((at + i + 1, at + i))
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs_of(spark, rows)).collect()}
    assert got == want


def test_recall_of_passages_near_the_threshold(spark):
    """Pairs with a window of 50 words at 0.8 or more, by brute force over all windows of all pairs."""
    rnd = random.Random(24)
    rows = []
    for case in range(60):
        p = prose(rnd, 50, 10**6).split()
        q = list(p)
        q[0 if case % 2 else 49] = "other"  # at one end: 45 of 47 shingles
        q[25] = "changed"
        if case % 3 == 0:
            q[25] = p[25]
        rows += [(2 * case, f"{prose(rnd, 20, 10**6)} {' '.join(p)}"), (2 * case + 1, f"{' '.join(q)} {prose(rnd, 20, 10**6)}")]

    def runs(text):
        w = text.split()
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return [frozenset(g[i : i + 46]) for i in range(len(g) - 45)]

    sets = {d: runs(t) for d, t in rows}
    near = {(2 * c + 1, 2 * c) for c in range(60) if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[2 * c] for b in sets[2 * c + 1])}
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs_of(spark, rows)).collect()}
    assert len(near) >= 20 and got <= near and len(got & near) >= 0.9 * len(near)


def test_no_link_of_runs_is_left_out(spark):
    """All pairs of runs of small texts, by brute force: linked ones are in a passage with each other, or
    connected by passages at their places; a passage may end as many words early as a similar run may lack."""
    rnd = random.Random(31)
    size, shingle, percent = 24, 3, 80
    rows = []
    for case in range(30):
        few = [f"w{case}x{i}" for i in range(6 if case % 3 == 0 else 300)]
        base = [rnd.choice(few) for _ in range(60)]
        for k in range(5):
            text = list(base[rnd.randint(0, 20) : rnd.randint(40, 60)])
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(text))
                text[i : i + rnd.randint(0, 1)] = [rnd.choice([*few, "new", f"n{rnd.random()}"])]
            rows.append((10 * case + k, " ".join([f"a{rnd.random()}" for _ in range(rnd.randint(0, 9))] + text + ["end of it"] * rnd.randint(0, 2))))

    def runs(text):
        w = text.split()
        g = [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
        return [frozenset(g[i : i + size - shingle + 1]) for i in range(len(w) - size + 1)]

    sets = {d: runs(t) for d, t in rows}
    got = passages.repeated_passages(docs_of(spark, rows), words=size, shingle=shingle, percent=percent).collect()
    slack = 2
    edges = set()
    for r in got:  # a passage is one thing: its runs in both documents
        own = [(r.doc_id, i) for i in range(r.start_word - slack, r.end_word - size + slack + 1)]
        own += [(r.source_doc_id, i) for i in range(r.source_start_word - slack, r.source_end_word - size + slack + 1)]
        own = [(d, i) for d, i in own if 0 <= i < len(sets[d])]
        edges |= {(own[0], x) for x in own[1:]}
    nodes = [(d, i) for d, s in sets.items() for i in range(len(s))]
    number = {x: i for i, x in enumerate(nodes)}
    group = plain_components(sorted(number.values()), [(number[a], number[b]) for a, b in edges])
    links = []
    for x in sets:
        for y in sets:
            if x < y and x // 10 == y // 10:
                links += [((x, i), (y, j)) for i, a in enumerate(sets[x]) for j, b in enumerate(sets[y]) if 100 * len(a & b) >= percent * len(a | b)]
    lost = [(a, b) for a, b in links if group[number[a]] != group[number[b]]]
    assert {(r.doc_id, r.source_doc_id) for r in got} <= {(b[0], a[0]) for a, b in links}
    assert len(links) > 1000 and not lost, (len(lost), len(links), lost[:5])


def test_variants_that_only_meet_behind_an_earlier_document(spark):
    """Each pair shares 50 words but for one; earlier documents have other variants of all parts of them."""
    rnd = random.Random(32)
    rows, want = [], set()
    for case in range(20):
        p = prose(rnd, 50, 10**6).split()
        q = list(p)
        q[rnd.randrange(50)] = "changed"
        at = 10 * case
        for k in range(3):
            rows.append((at + k, f"{prose(rnd, 30, 10**6)} {' '.join(p[12 * k : 12 * k + 26])} {prose(rnd, 30, 10**6)}"))
        rows += [(at + 5, f"{prose(rnd, 30, 10**6)} {' '.join(p)}"), (at + 6, f"{' '.join(q)} {prose(rnd, 30, 10**6)}")]
        want.add((at + 6, at + 5))
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs_of(spark, rows)).collect()}
    assert got == want


def test_pairs_without_a_passage_make_no_rows_at_last(spark, monkeypatch):
    """Near copies that are too far from each other: the last comparison of all pairs writes passages alone."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{i}-{j}" if rng.random() < 0.08 else w for j, w in enumerate(base))) for i in range(40)]
    written, write = {}, passages.Workspace.write

    def kept(self, df, name):
        written[name] = write(self, df, name)
        return written[name]

    monkeypatch.setattr(passages.Workspace, "write", kept)
    passages.repeated_passages(docs_of(spark, rows)).collect()
    assert written["open-2"].count() > 0
    assert written["found-rest"].where("end_word is null").count() == 0
    assert not {"runs", "postings"} & set(written)  # a row for each run or item is shuffled once, not written too


@pytest.mark.parametrize("members", [1 << 12, 16])
def test_a_common_passage_makes_few_pairs(spark, monkeypatch, members):
    """Three groups of documents share 40 words, too few for a link, and go on with a line of their group that is commoner still."""
    rnd = random.Random(41)
    one, other, *lines = prose(rnd, 40, 10**6), prose(rnd, 45, 10**6), *(prose(rnd, 14, 10**6) for _ in range(3))
    rows = [(i, f"{prose(rnd, 20, 10**6)} {one if i < 90 else other} {lines[i % 3]} {prose(rnd, 20, 10**6)}") for i in range(480)]
    asked, verified = [], passages._verified

    def counted(rows, near, pairs, t, shingle, percent, last=False):
        asked.append(pairs.count())
        return verified(rows, near, pairs, t, shingle, percent, last)

    monkeypatch.setattr(passages, "_verified", counted)
    monkeypatch.setattr(passages, "MEMBERS", members)
    got = [(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs_of(spark, rows)).collect()]
    group = plain_components(range(480), got)
    assert len({group[i] for i in range(90)}) == 3 and all(group[i] == i % 3 for i in range(90))
    assert sum(asked[1:]) < 1000, asked


def test_alike_windows_equal_sets():
    """No document with a similar run is left out, and those with too few items of every run are."""
    rnd = np.random.default_rng(6)
    t, percent = 20, 80
    told = 0
    for case in range(60):
        seq = rnd.integers(0, 12 if case % 3 == 0 else 10**6, 30).astype(np.uint64)
        sets, least, want, most = [], [], [], []
        for _ in range(30):
            other = seq.copy()
            other = np.where(rnd.random(30) < rnd.choice([0.05, 0.1, 0.4]), rnd.integers(10**7, 10**8, 30).astype(np.uint64), other)
            runs = [set(other[i : i + t].tolist()) for i in range(11)]
            own = [set(seq[i : i + t].tolist()) for i in range(11)]
            sets.append(np.unique(other))
            least.append(min(map(len, runs)))
            want.append(any(100 * len(a & b) >= percent * len(a | b) for a in own for b in runs))
            most.append(len(set(seq.tolist()) & set(other.tolist())))
        of, owner = np.concatenate(sets), np.repeat(np.arange(30), [len(x) for x in sets])
        order = np.argsort(of, kind="stable")
        got = passages.alike_windows(seq, (of[order], owner[order]), np.array(least), t, percent)
        assert not (np.array(want) & ~got).any()
        if case % 3:
            assert not got[np.array(most) < 16].any()
        told += int((~got).sum())
    assert told > 100


def test_passages_at_a_later_place_of_the_leader(spark):
    rnd = random.Random(20)
    rows = []
    for case in range(12):
        lines = [prose(rnd, 10, 10**6) for _ in range(7)]
        apart = " ".join(f"{x} {prose(rnd, 50, 10**6)}" for x in lines)
        rows += [(10 * case, f"{apart} {' '.join(lines)}"), (10 * case + 1, f"{' '.join(lines)} {prose(rnd, 30, 10**6)}")]
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs_of(spark, rows)).collect()}
    assert got == {(10 * case + 1, 10 * case) for case in range(12)}


# --- decontamination --------------------------------------------------------------------
def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(max(r) for r in h)


def test_alignment_equals_plain():
    rnd = np.random.default_rng(11)
    for _ in range(60):
        a, b = rnd.integers(0, 4, rnd.integers(1, 15)), rnd.integers(0, 4, rnd.integers(1, 25))
        score, end = decontam.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert score == smith_waterman(a.tolist(), b[:end].tolist())


def test_leaks(spark, monkeypatch):
    rnd = random.Random(12)
    items = [(i, prose(rnd, 30)) for i in range(8)] + [(8, "too short"), (9, None), (10, "")]
    text = dict(items)
    edited = text[2].split()
    edited[7], edited[19] = "other", "words"
    del edited[12]
    rows = [(i, prose(rnd, 200)) for i in range(30)]
    rows[4] = (4, f"{prose(rnd, 50)} {text[1].upper()}! {prose(rnd, 50)}")
    rows[7] = (7, f"{' '.join(edited)} {prose(rnd, 50)}")
    rows[8] = (8, " ".join(text[3].split()[:10]))
    rows += [(100 + i, f"{text[5]} {prose(rnd, 3)}") for i in range(200)] + [(300, None), (None, text[6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(4, 1), (7, 2), (None, 6)} | {(100 + i, 5) for i in range(200)}
    got = decontam.find_leaks(with_clashes(docs_of(spark, rows)), with_clashes(bench), often=3).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    r = next(r for r in got if r.doc_id == 4)
    assert (r.score, r.most, r.start_word, r.end_word) == (60, 60, 50, 80)
    monkeypatch.setattr(decontam, "PASS_WORDS", 50)  # several passes give the same
    again = decontam.find_leaks(docs_of(spark, rows), bench, often=3).collect()
    assert {(r.doc_id, r.item_id) for r in again} == want
    assert decontam.find_leaks(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontam.find_leaks(empty(spark), bench).count() == 0


@pytest.mark.parametrize("copies", [10, 51, 2000])
def test_edited_copies_are_found_however_many(spark, copies):
    rnd = random.Random(15)
    item = " ".join(f"i{k}" for k in range(40))
    edited = " ".join("changed" if k % 5 == 4 else w for k, w in enumerate(item.split()))
    rows = [(i, f"{prose(rnd, 3)} {edited} {prose(rnd, 3)}") for i in range(copies)] + [(9000, " ".join(item.split()[:9]))]
    got = decontam.find_leaks(docs_of(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(copies))


def test_leaks_of_items_with_bare_punctuation_and_few_words(spark):
    rnd = random.Random(25)
    items = [(1, "( alpha ) ( beta ) ( gamma ) ( delta ) ( epsilon ) ( zeta )"), (2, "x = f ( y ) ;"), (3, "one two"), (4, "Solo!"), (5, "...")]
    rows = [(1, f"{prose(rnd, 20)} {items[0][1]} {prose(rnd, 20)}"), (2, f"{prose(rnd, 5)} -- {items[1][1]}"), (3, f"One. TWO {prose(rnd, 9)}"), (4, f"one {prose(rnd, 3)} two"), (5, "solo"), (6, prose(rnd, 60)), (6, prose(rnd, 60)), (7, "word " * 60_000 + "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in decontam.find_leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1): (21, 37), (2, 2): (6, 11), (3, 3): (0, 2), (5, 4): (0, 1), (7, 3): (60_000, 60_002)}


def test_leaks_equal_alignment_of_all_pairs(spark):
    """Every (document, item) that shares an n-gram, aligned whole against whole by the plain matrix."""
    rnd = random.Random(26)
    items = [(i, prose(rnd, 24, 400)) for i in range(6)]
    rows = []
    for d in range(60):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = f"w{rnd.randint(0, 400)}"
        rows.append((d, f"{prose(rnd, 15, 400)} {' '.join(w)} {prose(rnd, 15, 400)}"))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        a = t.split()
        for i, x in items:
            b = x.split()
            if {tuple(a[k : k + 3]) for k in range(len(a) - 2)} & {tuple(b[k : k + 3]) for k in range(len(b) - 2)}:
                score = smith_waterman(b, a)
                if 100 * score >= 50 * 2 * len(b):
                    want[d, i] = score
    assert len(want) > 20 and got == want


def test_common_words_bound_the_score():
    rnd = np.random.default_rng(16)
    for _ in range(200):
        a, b = rnd.integers(0, 6, rnd.integers(1, 20)), rnd.integers(-1, 8, rnd.integers(1, 30))
        assert decontam.align(a, b)[0] <= decontam.MATCH * decontam.most_common(np.unique(a, return_counts=True), b)
