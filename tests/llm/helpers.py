"""Small tables with every awkward case, and plain models."""

import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("kept", "cls", "u", "v", "shard", "slot", "size", "length", "bands", "_block", "file", "score", "key")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randint(0, vocabulary)}" for _ in range(n))


def edge_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, odd characters."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (None, None),
        (6, "two words"), (7, "Two WORDS"), (8, "é ü 👍🏽 日本語\x1cx"), (9, "word " * 30_000), (10, "same line here for all\n" * 50), (11, "<|endoftext|> 'tis don't"),
    ]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return Counter(tuple(r) for r in df.collect())


def components(n, links):
    up = {i: i for i in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}
