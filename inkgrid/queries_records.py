"""Queries of state, text, rendering, compliance figures and the SQL surface, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import both
from .functions import text as tx
from .operators import analytics, render, state, vectors
from .views import regions


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- compliance figures over events -------------------------------------------------
_LOGS = "logs AS (SELECT event_id, ts AS created_at, event_type = 'error' AS has_fatal_failure, event_type AS submission_source, CASE WHEN user_id % 3 > 0 THEN concat('v', user_id % 3) END AS schema_version, props FROM events), since AS (SELECT max(ts) - INTERVAL 7 DAY AS s FROM events)"


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("_since"))
    version = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")))
    logs = e.select("event_id", F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("has_fatal_failure"), F.col("event_type").alias("submission_source"), version.alias("schema_version"), F.col("props").alias("inspection_data"))
    return logs.crossJoin(F.broadcast(since))  # one row


@both(f"WITH {_LOGS} SELECT count(*) AS total_submissions, count(*) FILTER (has_fatal_failure) AS fatal_failures, round((count(*) - count(*) FILTER (has_fatal_failure)) / count(*), 4) AS pass_rate FROM logs, since WHERE created_at >= s")
def kpi_totals(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.totals(_logs(spark, sf), F.col("_since"))


@both(f"WITH {_LOGS} SELECT submission_source, count(*) AS cnt FROM logs, since WHERE created_at >= s GROUP BY 1")
def kpi_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.by_source(_logs(spark, sf), F.col("_since"))


@both(f"WITH {_LOGS} SELECT schema_version, count(*) AS cnt FROM logs WHERE schema_version IS NOT NULL GROUP BY 1")
def kpi_by_version(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.by_version(_logs(spark, sf))


@both(f"WITH {_LOGS}, a AS (SELECT unnest(json_keys(props)) AS key, props FROM logs, since WHERE created_at >= s) SELECT key, count(*) AS fail_count FROM a WHERE json_extract_string(props, '$.' || key) = '7' GROUP BY key ORDER BY fail_count DESC, key LIMIT 10")
def kpi_failing_criteria(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.failing_criteria(_logs(spark, sf), F.col("_since"), failed="7")


@both("SELECT event_type AS hypothesis_type, count(*) AS n, count(*) FILTER (value > 50) AS accepted, count(*) FILTER (NOT value > 50) AS rejected FROM events GROUP BY 1")
def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.layer_counts(_t(spark, sf, "events").select(F.col("event_type").alias("hypothesis_type"), (F.col("value") > 50).alias("accepted")))


@both("SELECT o_orderpriority AS department, coalesce(CASE WHEN o_custkey % 5 > 0 THEN concat('d', o_custkey % 5) END, 'General') AS device, array_to_string(list_sort(list_distinct(list(coalesce(CASE WHEN o_orderkey % 4 > 0 THEN concat('f', o_orderkey % 4) END, 'unknown')))), ',') AS form_types, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS sources FROM orders WHERE o_orderkey % 9 > 0 GROUP BY 1, 2")
def metadata_structure(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    name = lambda c, n, p: F.when(F.col(c) % n > 0, F.concat(F.lit(p), (F.col(c) % n).cast("string")))
    rows = o.select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).alias("department"), name("o_custkey", 5, "d").alias("device"), name("o_orderkey", 4, "f").alias("form_type"), F.col("o_orderstatus").alias("source"))
    out = analytics.structure(rows)
    return out.select("department", "device", F.array_join("form_types", ",").alias("form_types"), F.array_join("sources", ",").alias("sources"))


@both("WITH expected(name, type) AS (VALUES ('view', 'a'), ('nothing', 'click'), ('none', 'no')) SELECT name, type, name IN (SELECT event_type FROM events) OR type IN (SELECT event_type FROM events) AS produced FROM expected")
def produced_stages(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([("view", "a"), ("nothing", "click"), ("none", "no")], "name string, type string")
    made = _t(spark, sf, "events").select(F.col("event_type").alias("stage_name"), F.col("event_type").alias("artifact_type"))
    return analytics.produced_stages(expected, made)


@both("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def latest_documents(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderdate")
    return analytics.top_k(own, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 200)


@both("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' ORDER BY event_id LIMIT 10")
def json_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id")
    return analytics.top_k(own, [F.col("event_id")], 10)


@both("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def device_departments(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


# --- ledger, lifecycle, versions ----------------------------------------------------
_OPS = "ops AS (SELECT event_id, concat('op', event_id // 2 * 2 % 5000) AS operation_id, concat('t', user_id % 40) AS template_id, ts FROM events)"


def _ops(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", F.concat(F.lit("op"), (F.floor(F.col("event_id") / 2) * 2 % 5000).cast("string")).alias("operation_id"), F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("template_id"), "ts")


@both(f"WITH {_OPS} SELECT event_id, operation_id, n = 1 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY ts, event_id) AS n FROM ops)")
def operation_ledger(spark: SparkSession, sf: str) -> DataFrame:
    kept, refused = state.first_wins(_ops(spark, sf), "operation_id", ["ts", "event_id"])
    return kept.withColumn("accepted", F.lit(True)).union(refused.withColumn("accepted", F.lit(False))).select("event_id", "operation_id", "accepted")


_STATES = ("INGESTED", "EXTRACTED", "GENERATED", "QA_PENDING", "APPROVED", "LIVE")
_PICK = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"


@both(f"""WITH e AS (SELECT event_id, user_id % 200 AS template_id, ts, {_PICK} AS state FROM events),
l AS (SELECT *, lag(state) OVER (PARTITION BY template_id ORDER BY ts, event_id) AS from_state FROM e),
legal(f, t) AS (VALUES {", ".join(f"('{k}', '{s}')" for k, v in state.TRANSITIONS.items() for s in v)})
SELECT event_id, from_state, state, CASE WHEN from_state IS NULL THEN state = 'INGESTED' ELSE EXISTS (SELECT 1 FROM legal WHERE f = from_state AND t = state) END AS legal FROM l""")
def lifecycle_transitions(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.array(*[F.lit(s) for s in _STATES])[(F.col("event_id") % 6).cast("int")]
    e = _t(spark, sf, "events").select("event_id", (F.col("user_id") % 200).alias("template_id"), "ts", pick.alias("state"))
    return state.transitions(e, "template_id", ["ts", "event_id"]).select("event_id", "from_state", "state", "legal")


@both("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return state.latest_wins(own, ["user_id"], ["ts", "event_id"]).drop("ts")


@both(f"WITH {_OPS} SELECT template_id, count(*) + 1 AS version, array_to_string(list_sort(list(operation_id)), ',') AS lineage FROM ops GROUP BY 1")
def template_versions(spark: SparkSession, sf: str) -> DataFrame:
    return state.versions(_ops(spark, sf), "template_id").withColumn("lineage", F.array_join("lineage", ","))


@both("SELECT p_partkey AS region_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def patched_regions(spark: SparkSession, sf: str) -> DataFrame:
    ops = _t(spark, sf, "lineitem").where("l_linenumber = 1").select(F.when(F.col("l_returnflag") == "R", "line_rejection").otherwise("line_approval").alias("operation_type"), F.array("l_partkey").alias("target_evidence_ids"))
    return state.patch_regions(_t(spark, sf, "part").select(F.col("p_partkey").alias("region_id")), ops)


@both("""WITH f AS (SELECT o_orderkey AS field_id, o_custkey % 100 AS doc, o_custkey // 100 AS row, o_orderstatus AS label, 'text' AS widget, o_totalprice < 200000 AS needs_qa FROM orders),
c AS (SELECT * FROM (SELECT c_custkey % 100 AS doc, c_custkey // 100 AS row, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS label, CASE WHEN c_nationkey % 2 = 0 THEN 'date' END AS widget, row_number() OVER (PARTITION BY c_custkey % 100, c_custkey // 100 ORDER BY c_acctbal DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1),
j AS (SELECT f.*, c.label AS nl, c.widget AS nw, c.doc IS NOT NULL AND row_number() OVER (PARTITION BY f.doc, f.row ORDER BY field_id) = 1 AS hit FROM f LEFT JOIN c ON f.doc = c.doc AND f.row = c.row)
SELECT field_id, doc, row, CASE WHEN hit THEN coalesce(nullif(nl, ''), label) ELSE label END AS label, CASE WHEN hit THEN coalesce(nullif(nw, ''), widget) ELSE widget END AS widget, needs_qa AND NOT hit AS needs_qa, hit AS human_corrected FROM j""")
def applied_corrections(spark: SparkSession, sf: str) -> DataFrame:
    return _corrected(spark, sf).select("field_id", "doc", "row", "label", "widget", "needs_qa", "human_corrected")


def _corrected(spark: SparkSession, sf: str) -> DataFrame:
    f = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("field_id"), (F.col("o_custkey") % 100).alias("doc"), F.floor(F.col("o_custkey") / 100).alias("row"), F.col("o_orderstatus").alias("label"), F.lit("text").alias("widget"), (F.col("o_totalprice") < 200000).alias("needs_qa"))
    c = _t(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("doc"), F.floor(F.col("c_custkey") / 100).alias("row"), F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("label"), F.when(F.col("c_nationkey") % 2 == 0, "date").alias("widget"), F.col("c_acctbal").alias("v1"), F.col("c_custkey").alias("v2"))
    return state.apply_corrections(f, c, ["doc", "row"], ["v1", "v2"])


@both("SELECT o_custkey AS doc, count(*) AS n_fields, count(*) FILTER (o_totalprice < 100000 AND o_orderstatus <> 'F') AS open_issues, CASE WHEN count(*) FILTER (o_totalprice < 100000 AND o_orderstatus <> 'F') = 0 THEN 'approved' ELSE 'pending' END AS qa_status FROM orders GROUP BY 1")
def document_approvals(spark: SparkSession, sf: str) -> DataFrame:
    f = _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_totalprice") < 100000).alias("needs_qa"), (F.col("o_orderstatus") == "F").alias("human_corrected"))
    return state.approvals(f, "doc")


@both("""WITH a AS (SELECT p_partkey AS id, p_brand, p_retailprice AS score, p_size * 1.0e0 AS x1 FROM part WHERE p_partkey % 10 < 9),
b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE p_brand END AS p_brand, p_retailprice + CASE WHEN p_partkey % 20 = 1 THEN 0.5 ELSE 0.001 END AS score, p_size + CASE WHEN p_partkey % 30 = 2 THEN 3.0e0 ELSE 0.5e0 END AS x1 FROM part WHERE p_partkey % 10 > 0 OR p_partkey % 50 = 0),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL OR b.id IS NULL AS miss, a.p_brand AS eb, b.p_brand AS ab, a.score AS es, b.score AS s2, a.x1 AS ex, b.x1 AS ax FROM a FULL JOIN b ON a.id = b.id)
SELECT id, '*' AS field, 'structural' AS category FROM j WHERE miss UNION ALL SELECT id, 'p_brand', 'value' FROM j WHERE NOT miss AND eb <> ab
UNION ALL SELECT id, 'score', 'confidence' FROM j WHERE NOT miss AND abs(es - s2) > 0.01 UNION ALL SELECT id, 'x1', 'spatial' FROM j WHERE NOT miss AND abs(ex - ax) > 1""")
def artifact_diff(spark: SparkSession, sf: str) -> DataFrame:
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    a = p.where(k % 10 < 9).select(k.alias("id"), "p_brand", F.col("p_retailprice").alias("score"), (F.col("p_size") * 1.0).alias("x1"))
    b = p.where((k % 10 > 0) | (k % 50 == 0)).select(k.alias("id"), F.when(k % 50 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"), (F.col("p_retailprice") + F.when(k % 20 == 1, 0.5).otherwise(0.001)).alias("score"), (F.col("p_size") + F.when(k % 30 == 2, 3.0).otherwise(0.5)).alias("x1"))
    return state.diff(a, b, ["id"], ["p_brand"], {"score": 0.01, "x1": 1.0}).select("id", "field", "category")


@both("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return state.dangling(items, "l_partkey", _t(spark, sf, "part").where("p_size > 5"), "p_partkey")


@both("SELECT event_type AS artifact_type, arg_max(event_id, (ts, event_id)) AS artifact_id FROM events GROUP BY 1")
def latest_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    own = _t(spark, sf, "events").select(F.col("event_type").alias("artifact_type"), F.col("event_id").alias("artifact_id"), "ts")
    return state.latest_wins(own, ["artifact_type"], ["ts", "artifact_id"]).drop("ts")


@both("SELECT event_id, CASE WHEN event_id % 7 < 5 THEN ts + to_seconds(cast(power(2, event_id % 7) * 60 AS bigint)) END AS retry_at FROM events WHERE event_type = 'error'")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").where("event_type = 'error'")
    return e.select("event_id", tx.retry_at(F.col("ts"), F.col("event_id") % 7).alias("retry_at"))


@both("SELECT o_orderstatus AS part, count(*) AS n, true AS same, count(*) FILTER (o_orderkey % 1000 = 0) = 0 AS same_with_change FROM orders GROUP BY 1")
def replay_is_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all columns of each part of a table, made again in another order, and
    with every thousandth price changed by a cent: only those parts differ."""
    own = _t(spark, sf, "orders")
    changed = own.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))

    def digest(d: DataFrame, name: str) -> DataFrame:
        return state.content_hash(d, sorted(own.columns), ("o_orderstatus",)).select(F.col("o_orderstatus").alias("part"), "n", F.struct("n", "parity", "total").alias(name))

    out = digest(own, "a").join(digest(own.repartition(7), "b").drop("n"), "part").join(digest(changed, "c").drop("n"), "part")
    return out.select("part", "n", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("same_with_change"))


@both("""WITH e AS (SELECT n_regionkey AS s, n_nationkey + 100 AS t FROM nation), u AS (SELECT s AS node, t AS other FROM e UNION ALL SELECT t, s FROM e) SELECT node, count(DISTINCT other) AS degree FROM u GROUP BY node""")
def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "nation").select(F.col("n_regionkey").alias("source"), (F.col("n_nationkey") + 100).alias("target"), F.lit("in").alias("edge_type"))
    return state.adjacency(e).select("node", "degree")


# --- texts --------------------------------------------------------------------------
@both("""WITH c AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[\\u0600-\\u06FF]', '', 'g')) AS a, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS l FROM documents)
SELECT doc_id, a AS arabic, l AS latin, CASE WHEN a + l = 0 THEN 'ar' WHEN a / (a + l) >= 0.65 THEN 'ar' WHEN a / (a + l) <= 0.30 THEN 'en' ELSE 'ar_en' END AS language FROM c""".replace("\\u0600", "؀").replace("\\u06FF", "ۿ"))
def text_language(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    out = _t(spark, sf, "documents").select("doc_id", tx.arabic_chars(t).cast("long").alias("arabic"), tx.latin_chars(t).cast("long").alias("latin"))
    return out.withColumn("language", tx.language(F.col("arabic"), F.col("latin")))


# The white space of Spark's trim and of DuckDB's is the blank alone; the patterns say which else counts.
_WIDGET = r"""CASE WHEN trim(t) = '' THEN 'text' WHEN regexp_matches(trim(t), '^[\s\x0b□☐☑✓✗\[\]\(\)\-_]{1,5}$') OR regexp_matches(trim(t), '(^|[\s\x0b])(□|☐|☑|✓|✗|\[[\s\x0b]*\]|\([\s\x0b]*\))([\s\x0b]|$)') THEN 'checkbox'
WHEN regexp_matches(trim(t), '[0-9٠-٩]{1,4}[/\-.\\][0-9٠-٩]{1,2}[/\-.\\][0-9٠-٩]{2,4}') OR regexp_matches(trim(t), '([/\-.\\][\s\x0b]*){2,}') THEN 'date' WHEN contains(lower(t), 'تاريخ') OR contains(lower(t), 'date') THEN 'date' WHEN contains(lower(t), 'رقم') OR contains(lower(t), 'number') THEN 'number'
WHEN contains(lower(t), 'ملاحظ') OR contains(lower(t), 'notes') OR contains(lower(t), 'تفاصيل') OR contains(lower(t), 'وصف') THEN 'textarea'
WHEN regexp_matches(trim(t), '^[0-9٠-٩.,\s\x0b+\-%]{1,20}$') THEN 'number' WHEN contains(trim(t), chr(10)) OR length(trim(t)) > 120 THEN 'textarea' ELSE 'text' END"""


@both(f"WITH d AS (SELECT doc_id, 0 AS line, text AS t FROM documents UNION ALL SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents) SELECT doc_id, cast(line AS integer) AS line, {_WIDGET} AS widget FROM d")
def widget_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each whole text (line 0) and of each of its lines."""
    d = _t(spark, sf, "documents").select("doc_id", "text")
    each = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return d.select("doc_id", F.lit(0).alias("line"), "text").unionByName(each).select("doc_id", "line", tx.widget(F.col("text")).alias("widget"))


@both("SELECT doc_id, concat(rtrim(substr(ltrim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 1, 30), '_'), '_', substr(md5(text), 1, 4)) AS slug FROM documents")
def text_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@both("SELECT doc_id, sha256(concat_ws('|', cast(doc_id AS varchar), lang, source)) AS stable_id, substr(md5(concat('doc:', cast(doc_id AS varchar))), 1, 8) AS uuid_head FROM documents")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return _t(spark, sf, "documents").select("doc_id", tx.stable_id(F.col("doc_id"), F.col("lang"), F.col("source")).alias("stable_id"), F.substring(tx.uuid_of("doc", key), 1, 8).alias("uuid_head"))


_LABELS = "concat(CASE user_id % 6 WHEN 0 THEN ' Mortality Rate ' WHEN 1 THEN 'Monthly fall rate' WHEN 2 THEN 'معدل العدوى' WHEN 3 THEN 'Bed occupancy rate (%)' ELSE event_type END, '')"


@both(f"WITH l AS (SELECT event_id, lower(trim({_LABELS})) AS c FROM events) SELECT event_id, CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in tx.SYNONYMS.items()) + " " + " ".join(f"WHEN contains(c, '{k}') THEN '{v}'" for k, v in tx.SYNONYMS.items()) + " END AS canonical FROM l")
def label_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    return tx.synonyms(_t(spark, sf, "events").select("event_id", F.expr(_LABELS).alias("text"))).select("event_id", "canonical")


@both(r"""WITH l AS (SELECT conv_id AS doc, turn AS pos, CASE WHEN turn % 5 = 0 THEN concat('# dep', turn // 5) WHEN turn % 5 = 2 THEN concat('## dev', turn) ELSE concat(role, turn) END AS line FROM (SELECT DISTINCT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)),
m AS (SELECT *, sum(CASE WHEN line LIKE '# %' THEN 1 ELSE 0 END) OVER w AS part, sum(CASE WHEN line LIKE '# %' OR line LIKE '## %' THEN 1 ELSE 0 END) OVER w AS sec, max(CASE WHEN line LIKE '# %' THEN pos END) OVER w AS hp FROM l WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, max(CASE WHEN line LIKE '## %' THEN pos END) OVER (PARTITION BY doc, part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sp FROM m),
t AS (SELECT h.doc, h.sec, substr(a.line, 3) AS h1, substr(b.line, 4) AS h2, h.pos, h.line FROM h LEFT JOIN l a ON a.doc = h.doc AND a.pos = h.hp LEFT JOIN l b ON b.doc = h.doc AND b.pos = h.sp WHERE NOT (h.line LIKE '# %' OR h.line LIKE '## %'))
SELECT doc, h1, h2, string_agg(line, chr(10) ORDER BY pos) AS chunk FROM t GROUP BY doc, sec, h1, h2""")
def header_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("turn").alias("pos")).agg(F.min("role").alias("role"))
    turn = F.col("pos").cast("string")
    line = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("# dep"), F.floor(F.col("pos") / 5).cast("string"))).when(F.col("pos") % 5 == 2, F.concat(F.lit("## dev"), turn)).otherwise(F.concat("role", turn))
    return render.header_chunks(c.select("doc", "pos", line.alias("line")), "doc")


@both("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 0 THEN l_returnflag ELSE concat(l_returnflag, '_', n) END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) - 1 AS n FROM lineitem)")
def unique_keys(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "lineitem").withColumn("_o", F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    return render.unique_keys(items, ["l_orderkey"], "l_returnflag", "_o").select("l_orderkey", "l_linenumber", "l_partkey", "unique_key")


@both("SELECT l_orderkey AS doc, string_agg(concat(l_returnflag, l_linenumber), ' | ' ORDER BY l_partkey * 1000000 + l_suppkey * 10 + l_linenumber, concat(l_returnflag, l_linenumber)) AS row_text FROM lineitem GROUP BY 1")
def row_texts(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "lineitem").withColumn("_o", F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("_o", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t")))), lambda c: c["t"])
    return items.groupBy(F.col("l_orderkey").alias("doc")).agg(render.row_text(cells).alias("row_text"))


@both("SELECT doc_id, regexp_matches(text, '[ﭐ-﷿ﹰ-﻿]') AS forms, contains(text, 'trash') AS found FROM documents")
def presentation_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tx.has_presentation_forms(F.col("text")).alias("forms"), F.contains("text", F.lit("trash")).alias("found"))


# --- rendering ----------------------------------------------------------------------
@both("""WITH f AS (SELECT region_id, page // 3 AS page, region_id % 4 AS row, region_id AS col FROM regions_),
n AS (SELECT *, count(*) OVER (PARTITION BY page, row) AS n, row_number() OVER (PARTITION BY page, row ORDER BY col) AS place FROM f)
SELECT region_id, cast(place AS integer) AS place, cast(CASE WHEN n = 1 THEN 12 ELSE greatest(1, 12 // n) + CASE WHEN place = 1 AND 12 - greatest(1, 12 // n) * n > 0 THEN 1 ELSE 0 END END AS integer) AS width FROM n""".replace("regions_", "(SELECT p_partkey AS region_id, p_partkey // 2 AS page FROM part)"))
def row_layout(spark: SparkSession, sf: str) -> DataFrame:
    f = regions(spark, sf).select("region_id", F.floor(F.col("page") / 3).alias("page"), (F.col("region_id") % 4).alias("row"), F.col("region_id").alias("col"))
    return render.row_layout(f).select("region_id", "place", "width")


@both("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'checkbox' ELSE 'text' END AS field_type, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE event_type END AS value FROM events")
def canonical_fields(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 4 == 0, " [X] ").when(F.col("event_id") % 4 == 1, "unchecked").otherwise(F.col("event_type"))
    return _t(spark, sf, "events").select("event_id", render.canonical_type(v).alias("field_type"), render.canonical_value(v).alias("value"))


# --- the wider SQL surface ----------------------------------------------------------
def _sql(name: str, text: str, *tables: str, spark_text: str | None = None) -> None:
    """Registers a query whose SQL runs on both engines."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(spark_text or text, **{t: _t(spark, sf, t) for t in tables})

    run.__name__ = name
    sql = text
    for t in tables:
        sql = sql.replace("{" + t + "}", t)
    both(sql)(run)


_sql("pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem")
_sql("segment_revenue", "SELECT c_mktsegment, year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment, year(o_orderdate)", "customer", "orders")
_sql("customers_without_orders", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", "customer", "orders")
_sql("customers_with_large_orders", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)", "customer", "orders")
_sql("full_join_counts", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) b ON a.k = b.k", "customer", "supplier")
_sql("rollup_sales", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS level, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_sql("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_sql("grouping_sets_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
_sql("moving_totals", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quart FROM {orders}", "orders")
_sql("set_operations", "(SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0", "customer", "supplier", "nation")
_sql("union_all_counts", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM {customer} UNION ALL SELECT 's' FROM {supplier}) AS u GROUP BY kind", "customer", "supplier")
_sql("correlated_average", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")
_sql("distinct_aggregates", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag", "lineitem")
_sql("percentile_prices", "SELECT p_brand, round({q}, 6) AS q3, median(p_retailprice) AS med FROM part GROUP BY p_brand".replace("{q}", "quantile_cont(p_retailprice, 0.75)").replace("FROM part", "FROM {part}"), "part", spark_text="SELECT p_brand, round(percentile(p_retailprice, 0.75), 6) AS q3, median(p_retailprice) AS med FROM {part} GROUP BY p_brand")
_sql("hourly_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY date_trunc('hour', ts), event_type", "events")


@both("""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS brk FROM events),
s AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with a gap of over 6 hours; the closed bound needs lag, not session_window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf, "events").withColumn("_b", (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS")).cast("int"))
    e = e.withColumn("_s", F.sum(F.coalesce("_b", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "_s").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).drop("_s")


@both("SELECT e.event_id, o.o_orderkey FROM events e ASOF JOIN (SELECT o_custkey, o_orderdate + INTERVAL 9000 DAY AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.at")
def as_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order at each event, without a range join: both sides in one sorted
    window per key, and the last order seen so far."""
    o = _t(spark, sf, "orders").groupBy("o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAYS")).alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    left = _t(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    right = o.select(F.col("o_custkey").alias("k"), "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("o_orderkey", F.last("o_orderkey", True).over(w)).where("side = 1 AND o_orderkey IS NOT NULL").select("event_id", "o_orderkey")


@both("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.q, v.vec_id, list_cosine_similarity(q.e, v.embedding) AS c FROM q JOIN embeddings v ON v.vec_id <> q.q) SELECT q, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 5) DESC, vec_id) AS n FROM s) WHERE n <= 5""")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each query vector, all rows against a stated query set."""
    v = _t(spark, sf, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 100 = 0"), 5).select("q", "vec_id")
