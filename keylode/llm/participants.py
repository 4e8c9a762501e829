"""The documents that take part in a comparison: one text for each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.work import Work

#: The column of `versions`.
OWN = "__keylode_own"
#: Up to so many ids (a few MB) are broadcast; beyond that both sides are shuffled.
BROADCAST_IDS = 200_000


def bounded(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast where they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """The ids that more than one row has, or None if there are none."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return ids if ids.head(1) else None


def versions(docs: DataFrame, work: Work) -> DataFrame:
    """docs with a column OWN, an id of each text: the doc_id, but for further texts of an
    id that has several, which get a 63-bit hash of id and text (a string for ids that
    are strings).  Rows of equal id and text share it; rows without an id have none."""
    if repeated_ids(docs.select("doc_id")) is None:
        return docs.withColumn(OWN, F.col("doc_id"))
    least = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__keylode_id")).agg(F.min("text").alias("__keylode_least"), F.count("*").alias("__keylode_n")).where("__keylode_n > 1")
    least = work.table(least.drop("__keylode_n"), "least_texts")
    text = docs.schema["doc_id"].dataType.simpleString() == "string"
    other = F.concat("doc_id", F.lit("#"), F.sha2(F.coalesce("text", F.lit("")), 256)) if text else F.xxhash64("doc_id", "text").bitwiseAND(2**63 - 1)
    same = F.col("__keylode_id").isNull() | F.col("text").eqNullSafe(F.col("__keylode_least"))
    own = F.when(same, F.col("doc_id") if text else F.col("doc_id").cast("long")).otherwise(other)
    return docs.join(least, F.col("doc_id") == F.col("__keylode_id"), "left").select(*docs.columns, own.alias(OWN))


def one_text(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, text: one row for each id that isn't null; of several texts of one id
    the least counts (nulls only where there is no other)."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    if repeated_ids(docs.select("doc_id")) is None:
        return rows
    ids = work.table(repeated_ids(docs.select("doc_id")), "repeated_ids")
    own = work.table(rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "repeated_texts")
    return rows.join(bounded(ids), "doc_id", "left_anti").unionByName(own)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents (one row each) whose doc_id is in ids."""
    return docs.select("doc_id", "text").join(bounded(ids), "doc_id", "left_semi")

