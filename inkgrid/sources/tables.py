"""Tables of the engine: definitions, append-only writes with latest-wins reads, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest_wins

TABLES = {
    "documents": "document_id STRING, data STRING, qa_status STRING, processed_at TIMESTAMP, version BIGINT, day DATE",
    "corrections": "document_id STRING, page INT, row INT, col INT, label STRING, widget STRING, at TIMESTAMP, version BIGINT, day DATE",
    "form_schemas": "document_id STRING, form STRING, version BIGINT, day DATE",
    "page_images": "document_id STRING, page INT, image BINARY, version BIGINT, day DATE",
}


def create(spark: SparkSession, prefix: str = "") -> None:
    """Creates the tables, partitioned by day."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet PARTITIONED BY (day)")


def save(df: DataFrame, table: str) -> None:
    """Appends rows; a later version of a key replaces the one before it for readers."""
    df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)


def current(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    return latest_wins(spark.table(table), keys, ["version"])


def lookup(rows: DataFrame, keys: list[str], wanted: dict[str, object], schema: str | None = None) -> DataFrame:
    """The newest rows of given keys in a table of versions; JSON bodies parsed if a schema is given."""
    for k, v in wanted.items():
        rows = rows.where(F.col(k) == v)
    newest = latest_wins(rows, keys, ["version"])
    return newest.withColumn("data", F.from_json("data", schema)) if schema else newest


def get(spark: SparkSession, table: str, key: str, value: str, schema: str | None = None) -> DataFrame:
    """The current row of a key; its JSON body parsed if a schema is given."""
    return lookup(spark.table(table), [key], {key: value}, schema)


def list_documents(spark: SparkSession, table: str, qa_status: str | None = None, most: int = 200) -> DataFrame:
    rows = current(spark, table, ["document_id"])
    rows = rows.where(F.col("qa_status") == qa_status) if qa_status else rows
    return rows.orderBy(F.col("processed_at").desc(), "document_id").limit(most)


def structure_json(structure: DataFrame) -> DataFrame:
    """One JSON object per department: device to its form types and sources."""
    entry = F.struct("device", F.struct("form_types", "sources"))
    nested = structure.groupBy("department").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("devices"))
    return nested.select(F.to_json(F.struct("department", "devices")).alias("value"))


def write_structure(structure: DataFrame, path: str) -> None:
    structure_json(structure).write.mode("overwrite").text(path)
