"""The training-data queries over the driver tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import find_leaks
from .htmltext import extract_text
from .idfiles import read_ids, write_ids
from .linededup import join_lines
from .neardup import near_duplicates
from .packing import pack_documents
from .passages import repeated_passages
from .quality import judge_quality
from .sharding import shard_documents
from .warc import read_pages, write_pages

#: The vocabulary file that the queries use; operators take it as a parameter.
VOCABULARY = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(sql: str) -> Callable:
    """Registers the SQL that a query must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[f.__name__] = sql
        return f

    return add


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op9_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(*write_ids(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_COUNTS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest({_WORDS.format(t="text")}) AS w, generate_subscripts({_WORDS.format(t="text")}, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) AS r(k) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM l GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(per.n, 0) AS n_words, cast(coalesce(chars, 0) AS bigint) AS word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, cast(coalesce(dup.n, 0) AS bigint) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a"""


@query
@oracle(_COUNTS_SQL)
def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4, which SQL can express; the verdict of the trees can't."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: Classes of equal sets with Jaccard links, and the least label of each component.
_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
adj AS (SELECT u AS a, v AS b FROM links UNION ALL SELECT v, u FROM links),
lab(a, m) USING KEY (a) AS (SELECT doc_id, doc_id FROM w UNION SELECT adj.b, min(x.m) FROM lab x JOIN adj ON adj.a = x.a JOIN recurring.lab y ON y.a = adj.b AND y.m > x.m GROUP BY adj.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, lab.m AS component_id, lab.m = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN lab ON lab.a = w.doc_id"""


@query
@oracle(_NEAR_SQL)
def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


#: All pairs of line classes whose sizes and parity maps allow a link, checked on their sets.
_LINES_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
s AS (SELECT doc_id, k, list_sort(list_distinct({_WORDS.format(t=_LOWER.format(t="t"))})) AS ws FROM l),
r AS (SELECT *, len(ws) AS n FROM s WHERE len(ws) > 0),
c AS (SELECT ws, n, row_number() OVER () AS cls, arg_min(doc_id, (doc_id, k)) AS cd, arg_min(k, (doc_id, k)) AS ck FROM r GROUP BY ws, n),
p AS (SELECT cls, {", ".join(f"coalesce(bit_xor(cast(1 AS ubigint) << cast(h % 64 AS ubigint)) FILTER (h // 64 = {i}), 0) AS p{i}" for i in range(8))} FROM (SELECT cls, hash(unnest(ws)) % 512 AS h FROM c) GROUP BY cls),
f AS (SELECT c.*, {", ".join(f"p{i}" for i in range(8))} FROM c JOIN p USING (cls)),
slim AS (SELECT * EXCLUDE (ws, cd, ck) FROM f),
sizes AS (SELECT x.n AS na, y.n AS nb FROM (SELECT DISTINCT n FROM c) x JOIN (SELECT DISTINCT n FROM c) y ON x.n <= y.n AND 100 * x.n >= 80 * y.n),
cand AS (SELECT a.cls AS u, b.cls AS v FROM slim a JOIN sizes ON a.n = na JOIN slim b ON b.n = nb WHERE (na < nb OR a.cls < b.cls) AND {" + ".join(f"cast(bit_count(xor(a.p{i}, b.p{i})) AS integer)" for i in range(8))} <= (na + nb) / 9.0e0 + 0.001e0),
near AS (SELECT u, v FROM (SELECT u, v, a.n + b.n AS n, len(list_intersect(a.ws, b.ws)) AS common FROM cand JOIN c a ON a.cls = u JOIN c b ON b.cls = v) WHERE 100 * common >= 80 * (n - common)),
both_ways AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
k AS (SELECT u AS cls, count(*) AS n_links, min((o.cd, o.ck)) AS first FROM both_ways JOIN f o ON o.cls = v GROUP BY u),
z AS (SELECT f.ws, f.cls, f.cd, f.ck, coalesce(n_links, 0) AS n_links, least((f.cd, f.ck), coalesce(k.first, (f.cd, f.ck))) AS e FROM f LEFT JOIN k USING (cls))
SELECT r.doc_id, cast(r.k AS integer) AS line_no, cast(r.n AS integer) AS n_tokens, n_links, cd AS class_doc_id, cast(ck AS integer) AS class_line_no, e[1] AS first_doc_id, cast(e[2] AS integer) AS first_line_no, (r.doc_id, r.k) > e AS removed FROM r JOIN z USING (ws)"""


@query
@oracle(_LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_lines(table(spark, sf_dir, "documents"), least=1).drop("cls", "row_key")


@query
def op10_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_BITS = "array_to_string(list_transform(string_split(sha1(h), ''), lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), '')"
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_position(list_transform(range(32), lambda j: lpad(bin(j), 5, '0')), substr(bits, 5 * i + 1, 5)), 1)), '')"
_PAGES_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages), b AS (SELECT *, {_BITS} AS bits FROM p)
SELECT page_id, cast(octet_length(encode(h)) AS bigint) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM b"""


@query
@oracle(_PAGES_SQL)
def op2_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(*write_pages(table(spark, sf_dir, "pages")), strict=True).drop("payload", "url")


@query
def op3_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
