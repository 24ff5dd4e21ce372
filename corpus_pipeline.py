"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as
Parquet and reads it again as the next stage's docs. All but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm.common import Workspace, table
from inkgrid.llm.decontam import find_leaks
from inkgrid.llm.linededup import drop_lines, join_lines, row_key
from inkgrid.llm.neardup import near_duplicates
from inkgrid.llm.packing import pack_documents
from inkgrid.llm.quality import keep_quality
from inkgrid.llm.queries import vocabulary


#: Keys that are broadcast, at most: 8 MB of them. More meet the documents by a shuffle.
BROADCAST_KEYS = 1 << 20


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The documents whose key is not in the column doc_id of `gone`."""
    gone = Workspace(docs.sparkSession, "gone").write(gone.select(gone["doc_id"].alias("_gone")).distinct(), "keys")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(gone, key == gone["_gone"], "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go, each row by its own text: null,
    empty and blank texts have too few words, and go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five or more distinct words go if an earlier line is 0.8 similar; a document
    goes if no word of it is left. n_chars is the new length. Lines go only from the row
    that holds them; null texts stay."""
    return drop_lines(docs, join_lines(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 on five-word shingles, that with
    the smallest doc_id stays. A row without doc_id is known by its text, and comes after all
    with one. Of rows that are equal in doc_id and text one stays; rows of one doc_id with
    different texts are one document. Documents without words stay."""
    own = row_key(docs["text"])
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(own, 2)))
    found = near_duplicates(docs.select(key.alias("doc_id"), docs["text"].alias("text")), shingle=5, percent=80)
    left = _without(docs, key, found.where("not kept"))
    again = docs.groupBy(docs["doc_id"].alias("_id"), own.alias("_of")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = Workspace(spark, "again").write(again, "rows")
    if again.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(again["_id"]) & (row_key(left["text"]) == again["_of"])
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage aligned to a benchmark item go, and only those: a row is known
    by its doc_id and text."""
    key = F.xxhash64(docs["doc_id"], docs["text"])
    return _without(docs, key, find_leaks(docs.select(key.alias("doc_id"), docs["text"].alias("text")), table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 2048; a null or empty text is one end token."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: No stage but the base rules can be said in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            space.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
