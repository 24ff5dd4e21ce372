"""Form documents as nested columns, and canonical fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id

# Form components by widget and by semantic type, true and false marks.
COMPONENTS = {
    "text": "textfield", "number": "number", "radio": "radio", "select": "select", "date": "datetime", "datetime": "datetime", "textarea": "textarea", "checkbox": "checkbox",
    "repeating_rows": "datagrid", "signature": "signature", "nested_group": "panel", "hierarchical_table": "htmlelement", "file": "file", "unknown": "textfield",
}
DATE_FORMATS = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd HH:mm"}
SEMANTIC = {
    "pass_fail": "radio", "text": "textfield", "notes": "textarea", "number": "number", "date": "datetime", "select": "select",
    "multiselect": "selectboxes", "signature": "signature", "kpi_indicator": "htmlelement",
}
CLIENT_WIDGETS = ("number", "checkbox", "textarea", "select")
TRUE_MARKS, FALSE_MARKS = ("[x]", "[v]", "checked", "true"), ("[ ]", "unchecked", "false")
GRID_WIDTH = 12


def component(widget: Column, table: dict[str, str] = COMPONENTS, other: str = "textfield") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[widget], F.lit(other))


def row_layout(fields: DataFrame, by: tuple[str, ...] = ("page", "row"), rtl: Column | None = None) -> DataFrame:
    """The width of each field in its row of 12 columns: equal parts, and one more for
    the first if any are left over. Right-to-left rows begin with the last column."""
    order = F.when(rtl, -F.col("col")).otherwise(F.col("col")) if rtl is not None else F.col("col")
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(order))
    part = F.greatest(F.lit(1), F.floor(GRID_WIDTH / n).cast("int"))
    extra = ((place == 1) & (GRID_WIDTH - part * n > 0)).cast("int")
    return fields.withColumns({"place": place, "width": F.when(n == 1, GRID_WIDTH).otherwise(part + extra).cast("int")})


def _options(options: Column) -> Column:
    return F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o, i: F.struct(o.alias("label"), F.concat(F.lit("opt_"), i.cast("string")).alias("value")))


def form_rows(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The component of each field, with its place and width in its row. Fields: doc,
    page, row, col, label, widget, options (array), confidence, and rtl if rows may
    begin with the last column. A choice without options is a text field."""
    laid = row_layout(fields, (doc, "page", "row"), F.col("rtl") if "rtl" in fields.columns else None)
    options = _options(F.col("options"))
    chosen = F.col("widget").isin("radio", "select")
    kind = F.when(chosen & (F.size(options) == 0), "textfield").otherwise(component(F.col("widget")))
    key = F.concat(F.lit("f_"), F.substring(stable_id(F.col(doc), F.col("page"), F.col("row"), F.col("col")), 1, 32))
    formats = F.create_map(*[F.lit(x) for kv in DATE_FORMATS.items() for x in kv])
    return laid.withColumns({"type": kind, "key": key, "format": formats[F.col("widget")], "values": F.when(chosen & (F.size(options) > 0), options), "confidence": F.round("confidence", 3)})


def form_json(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One JSON document per doc: pages, rows and columns of components in order (see form_rows)."""
    item = F.struct("type", "format", "key", "label", "width", "values", F.struct("confidence", F.col("row").alias("row_index"), F.col("col").alias("col_index")).alias("properties"))
    rows = form_rows(fields, doc).groupBy(doc, "page", "row").agg(F.array_sort(F.collect_list(F.struct("place", item.alias("c")))).alias("cs")).withColumn("columns", F.transform("cs", lambda x: x["c"]))
    pages = rows.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("row", "columns"))).alias("rows"))
    whole = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "rows"))).alias("components"))
    return whole.select(doc, F.to_json(F.struct(F.lit("form").alias("display"), "components")).alias("form"))


def client_rows(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The components of the client's form: short keys, few types, no degraded choices;
    rows begin with the first column, whose width takes all that is left of the twelve. A
    lone text without a colon is a heading. Documents of several pages are wizards
    with a panel for each page."""
    w = Window.partitionBy(doc, "page", "row")
    n, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("col"))
    pages = F.max("page").over(Window.partitionBy(doc)) + 1
    label = F.coalesce("label", F.lit(""))
    still = (n == 1) & ~F.contains(label, F.lit(":")) & (F.col("widget") == "text")
    kind = F.when(still, "htmlelement").when(F.col("widget") == "date", "datetime").when(F.col("widget").isin(*CLIENT_WIDGETS), F.col("widget")).otherwise("textfield")
    width = F.when(n > 1, F.floor(GRID_WIDTH / n) + F.when(place == 1, GRID_WIDTH % n).otherwise(0)).cast("int")
    key = F.concat(F.lit("f_"), F.substring(stable_id(F.col(doc), F.col("page"), F.col("row"), F.col("col")), 1, 16))
    panel = F.when(pages > 1, F.concat(F.lit("page"), (F.col("page") + 1).cast("string")))
    values = F.when((F.col("widget") == "select") & (F.size(_options(F.col("options"))) > 0), _options(F.col("options")))
    return fields.select(doc, "page", "row", "col", place.alias("place"), kind.alias("type"), F.when(still, "h4").alias("tag"), key.alias("key"), label.alias("text"), width.alias("width"), panel.alias("panel"), F.when(pages > 1, "wizard").otherwise("form").alias("display"), values.alias("values"))


def canonical_components(schemas: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The form components of canonical schemas. schemas: doc, sections, an array of (id, label,
    fields), a field being (key, label, field_type, is_fatal, required, options), options
    an array of (value, label). Pass or fail is asked for where a field gives no options."""
    one = schemas.select(doc, F.posexplode("sections").alias("section_no", "s")).select(doc, "section_no", F.concat(F.lit("section_"), F.col("s.id")).alias("panel"), F.posexplode("s.fields").alias("field_no", "f"))
    kind = F.col("f.field_type")
    asked = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("label")) for v, t in (("pass", "Pass"), ("fail", "Fail"))])
    given = F.coalesce(F.size("f.options"), F.lit(0)) > 0
    values = F.when(kind.isin("pass_fail", "select", "multiselect") & given, F.col("f.options")).when(kind == "pass_fail", asked)
    shown = F.when(kind == "kpi_indicator", F.concat(F.lit('<span class="kpi-label">'), F.col("f.label"), F.lit("</span>")))
    return one.select(
        doc, "section_no", "field_no", "panel", component(kind, SEMANTIC).alias("type"), F.col("f.key").alias("key"), F.when(shown.isNull(), F.col("f.label")).alias("label"),
        F.when(shown.isNull(), F.col("f.required")).alias("required"), F.when(F.col("f.is_fatal") & shown.isNull(), "fatal-field").otherwise(F.when(shown.isNull(), "").otherwise("kpi-indicator")).alias("css"),
        values.alias("values"), shown.alias("content"),
    )


def canonical_type(value: Column) -> Column:
    """checkbox for values that are marks, else text."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*TRUE_MARKS, *FALSE_MARKS), "checkbox").otherwise("text")


def canonical_value(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*TRUE_MARKS), "true").when(low.isin(*FALSE_MARKS), "false").otherwise(value)


def canonical_documents(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Canonical documents: one page and one section, with fields in order of id."""
    item = F.struct("field_id", F.concat(F.lit("Field_"), F.substring("field_id", 1, 8)).alias("field_name"), canonical_type(F.col("value")).alias("field_type"), canonical_value(F.col("value")).alias("value"), F.col("final").alias("confidence_score"), F.col("field_id").alias("provenance_ref"))
    out = fields.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("fields"))
    return out.select(doc, F.array(F.struct(F.lit(1).alias("page_number"), F.array(F.struct(F.lit("Main Content").alias("title"), "fields")).alias("sections"))).alias("pages"))


def panels(documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Canonical documents as panels of form components."""
    parts = F.flatten(F.transform("pages", lambda p: p["sections"]))
    panel = lambda s: F.struct(F.lit("panel").alias("type"), s["title"].alias("title"), F.transform(s["fields"], lambda f: F.struct(f["field_name"].alias("key"), f["field_name"].alias("label"), f["value"].alias("defaultValue"), F.when(f["field_type"] == "checkbox", "checkbox").otherwise("textfield").alias("type"))).alias("components"))
    return documents.select(doc, F.to_json(F.struct(F.lit("form").alias("display"), F.transform(parts, panel).alias("components"))).alias("form"))


def schema_hash(sections: Column) -> Column:
    """A digest of the sections (id, label, fields of key, label, field_type, is_fatal) of a
    schema, over one string with the names in sorted order."""
    field = lambda f: F.concat_ws("\x1f", F.concat(F.lit("field_type="), f["field_type"]), F.concat(F.lit("is_fatal="), f["is_fatal"].cast("string")), F.concat(F.lit("key="), f["key"]), F.concat(F.lit("label="), f["label"]))
    section = lambda s: F.concat_ws("\x1e", F.concat(F.lit("id="), s["id"]), F.concat(F.lit("label="), s["label"]), F.array_join(F.transform(s["fields"], field), "\x1e"))
    return F.sha2(F.array_join(F.transform(sections, section), "\x1d"), 256)


def flat_criteria(schemas: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The criteria of canonical schemas: the fields of all sections but KPI indicators."""
    out = schemas.select(doc, F.posexplode(F.flatten(F.transform("sections", lambda s: s["fields"]))).alias("pos", "f")).where("f.field_type <> 'kpi_indicator'")
    return out.select(doc, "pos", F.col("f.key").alias("key"), F.col("f.label").alias("label"), F.col("f.is_fatal").alias("is_fatal"))


def unique_keys(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Keys made unique within a group: the n-th repeat gets _n."""
    n = F.row_number().over(Window.partitionBy(*by, key).orderBy(order)) - 1
    return rows.withColumn("unique_key", F.when(n == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), n.cast("string"))))


def header_chunks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks of a text under its first and second headers. lines: doc, pos, line."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first, second = F.col("line").rlike("^# "), F.col("line").rlike("^## ")
    out = lines.withColumn("h1", F.last(F.when(first, F.trim(F.expr("substr(line, 3)"))), True).over(w))
    out = out.withColumn("_s", F.count_if(first | second).over(w))
    out = out.withColumn("_part", F.count_if(first).over(w))
    inner = Window.partitionBy(doc, "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("h2", F.last(F.when(second, F.trim(F.expr("substr(line, 4)"))), True).over(inner)).where(~first & ~second)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return out.groupBy(doc, "_s", "h1", "h2").agg(F.trim(text).alias("chunk")).where("chunk <> ''").drop("_s")


def realigned(criteria: DataFrame, components: DataFrame, by: list[str]) -> DataFrame:
    """Criteria with the unique key of the component of their label; of several, the last one's."""
    last = components.groupBy(*by, "label").agg(F.max_by("unique_key", F.struct("pos", "unique_key")).alias("_key"))
    return criteria.join(last, [*by, "label"], "left").withColumn("key", F.coalesce("_key", "key")).drop("_key")


def table_rows(grid: DataFrame, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Rows of a grid as arrays without those that are empty; the first is a header if
    all its cells have a text."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", "text", "confidence"))), lambda c: F.struct(c["text"].alias("text"), F.round(c["confidence"], 4).alias("confidence")))
    rows = grid.groupBy(*by, "row").agg(cells.alias("cells"))
    rows = rows.withColumn("is_header", (F.col("row") == 0) & F.forall("cells", lambda c: F.trim(c["text"]) != ""))
    return rows.where(F.exists("cells", lambda c: F.trim(c["text"]) != ""))


def row_text(cells: Column) -> Column:
    return F.array_join(cells, " | ")
