"""A training corpus from raw documents, in five stages.

toxicity    documents that the classifier marks toxic go
near_dedup  one document of each group of near copies stays
passages    of passages that repeat across documents, one stays
privacy     personal data is replaced by its kind
packing     what is left is packed into sequences of 4096 tokens

Every stage reads what its predecessor wrote and keeps the columns of documents, but
for the last, which returns the pieces of the sequences.  Of empty tables every stage
makes empty ones; columns besides doc_id, text and n_chars are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.llm import op1_minhash, op2_pii, op3_packing, op6_toxicity, op7_substring
from keylode.llm.participants import OWN, bounded, versions
from keylode.llm.work import Work, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5.  Each row is scored by its own text, null and
    empty ones by the bias alone, so rows without an id and repeated rows stay or go by
    their text."""
    model = op6_toxicity.fit(docs, read(spark, sf_dir, "labels"))
    names = "__keylode_score", "__keylode_predicted"
    return op6_toxicity.score(docs, model, names).where(F.col(names[1]) == 0).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.  Texts
    without words and rows without an id stay.  Different texts of one id are documents
    of their own; of rows that repeat id and text the least (by all columns) stays."""
    work = Work(spark, "near_dedup")
    named = versions(docs, work)
    found = op1_minhash.near_duplicates(named.select(F.col(OWN).alias("doc_id"), "text"), work)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(OWN)).distinct()
    kept = named.join(bounded(gone), OWN, "left_anti")
    repeated = work.table(kept.where(F.col(OWN).isNotNull()).groupBy(OWN).count().where("count > 1").select(OWN), "repeated")
    if not repeated.head(1):
        return kept.select(*docs.columns)
    once = kept.join(repeated, OWN, "left_semi").groupBy(OWN).agg(F.min(F.struct(*docs.columns)).alias("__keylode_row")).select("__keylode_row.*")
    return kept.join(repeated, OWN, "left_anti").select(*docs.columns).unionByName(once)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that smaller documents hold.  Texts under 50 words,
    nulls and rows without an id stay as they are; different texts of one id are
    documents of their own."""
    return op7_substring.without_repeats(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, row by row; null texts stay
    null."""
    return op2_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences; a null text is one token, the end id, and every row
    is packed, repeated ones and those without an id too."""
    return op3_packing.packed(docs, op3_packing.tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("passages", passages), ("privacy", privacy), ("packing", packing)]

#: Learned scores and token ids aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read(spark, sf_dir, "documents"), Work(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.table(docs, name)
    return docs
