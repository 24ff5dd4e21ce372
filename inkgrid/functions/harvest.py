"""JSON found in free text and in nested documents; what built-in functions can't search."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that make a JSON object a form, bounds of a label.
FORM_KEYS = ("sections", "components")
LABEL_LENGTH = (3, 120)


def rescue_json(text: Column) -> Column:
    """The outermost JSON object in a text, without code fences around it; null if there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def find_form(document: Column, depth: int = 6) -> Column:
    """The first object with a form's keys in a JSON document, by depth-first search."""

    @F.pandas_udf("string")
    def run(s):
        def find(x, left: int):
            if isinstance(x, dict):
                if any(isinstance(x.get(k), list) for k in FORM_KEYS):
                    return x
                values = x.values()
            elif isinstance(x, list):
                values = x
            else:
                return None
            return next((f for v in values if left and (f := find(v, left - 1)) is not None), None)

        def one(t):
            try:
                got = find(json.loads(t), depth)
            except (TypeError, ValueError):
                return None
            return None if got is None else json.dumps(got, ensure_ascii=False, sort_keys=True)

        return s.map(one)

    return run(document)


def labels(document: Column, depth: int = 6) -> Column:
    """All labels of a nested document in order, each once."""

    @F.pandas_udf("array<string>")
    def run(s):
        def walk(x, left: int) -> Iterator[str]:
            if isinstance(x, dict):
                for k, v in x.items():
                    if k in ("label", "title", "name") and isinstance(v, str) and LABEL_LENGTH[0] < len(v.strip()) < LABEL_LENGTH[1]:
                        yield v.strip()
                    elif left:
                        yield from walk(v, left - 1)
            elif isinstance(x, list) and left:
                for v in x:
                    yield from walk(v, left - 1)

        def one(t):
            try:
                return list(dict.fromkeys(walk(json.loads(t), depth)))
            except (TypeError, ValueError):
                return []

        return s.map(one)

    return run(document)


# Characters of a text that a model is given, and the button that ends a form.
CONTEXT = 3500
SUBMIT = {"type": "button", "label": "Submit Inspection / إرسال التفتيش", "key": "submit_btn", "size": "md", "block": True, "action": "submit", "disableOnInvalid": True, "theme": "primary"}


def with_submit(form: Column) -> Column:
    """A form's JSON with a submit button as its last component, if it has none; null for what is no form."""

    def one(t: str | None) -> str | None:
        try:
            got = json.loads(t)
            parts = got["components"]
            if not any(c.get("type") == "button" and c.get("action") == "submit" for c in parts):
                parts.append(SUBMIT)
        except (TypeError, ValueError, KeyError, AttributeError):
            return None
        return json.dumps(got, ensure_ascii=False)

    return F.pandas_udf(lambda s: s.map(one), "string")(form)


def checklists(texts: DataFrame, client: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """Adds `answer`, what a model says of the first CONTEXT characters of each text, and `form`: the
    form found in the answer's JSON, with a submit button. Where the model fails, or
    says nothing of use, both or the form are null."""

    def ask(s):
        import pandas as pd

        try:
            return pd.Series(client([(x or "")[:CONTEXT] for x in s]), dtype=object)
        except Exception:  # rows of a failed call have no answer
            return pd.Series([None] * len(s), dtype=object)

    said = texts.withColumn("answer", F.pandas_udf(ask, "string")(F.col(text)))
    return said.withColumn("form", with_submit(find_form(rescue_json(F.col("answer")))))


def name_unknowns(labels_df: DataFrame, client: Callable[[list[str]], dict[str, str]], text: str = "text", canonical: str = "canonical") -> DataFrame:
    """Fills null canonical names by a client (a model), asked for distinct labels only;
    where it fails, names stay null."""
    unknown = labels_df.where(F.col(canonical).isNull() & (F.length(F.trim(text)) > 2)).select(F.trim(text).alias("_label")).distinct()

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            try:
                got = client(list(b["_label"]))
            except Exception:  # optional: labels stay without a name
                got = {}
            yield pd.DataFrame({"_label": b["_label"], "_name": [got.get(x) for x in b["_label"]]})

    named = unknown.mapInPandas(ask, "_label string, _name string")
    out = labels_df.join(named, F.trim(F.col(text)) == F.col("_label"), "left")
    return out.withColumn(canonical, F.coalesce(canonical, "_name")).drop("_label", "_name")
