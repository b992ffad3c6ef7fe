"""From documents to a training mix: five stages over the whole table, each by one operator.

Every stage takes what its predecessor kept and returns the columns of `documents`; the last
one adds how the mix uses a row. Between stages the rows are written to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import ready, table
from gleaner.llm.decontam import contamination
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.mixing import mixture
from gleaner.llm.pii import personal_data, redact
from gleaner.llm.quality import fit_quality
from gleaner.session import snapshot

METADATA = ("doc_id", "lang", "source", "n_chars")


def _with_row(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that a stage works on, and `row`, all columns as they came: whatever an input
    column is called, it meets no name that a stage uses inside."""
    return docs.select(*needed, F.struct(*docs.columns).alias("row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Rows and columns that stay are as they came. Null and empty texts are scored like any other, a
    score of exactly 0.5 stays, repeated rows are scored each, without labels of both classes all
    stay, an empty table stays empty. Texts are read whole.
    """
    ready(spark)
    labels = table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.select("doc_id", labels["quality"].alias("label")))
    known = [c for c in METADATA if c in docs.columns]
    return model.score(_with_row(docs, *known, "text")).filter("q_score >= 0.5").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate class; equal rows of one doc_id become one.

    Null and empty texts, and rows without doc_id, are in no class and stay, the latter as often
    as they are given. Of rows with one doc_id and one text, one stays, whatever else they hold.
    Columns are as they came; an empty table stays empty.
    """
    ready(spark)
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = _with_row(docs, "doc_id").withColumn("digest", F.xxhash64("row.text"))
    one = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"])
    return one.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.

    Null and empty texts have no window and stay, also without doc_id; repeated rows stay or go
    together. Items without words match nothing. Columns are as they came; an empty table, or
    an empty benchmark, changes nothing.
    """
    ready(spark)
    hit = (contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter(F.size("items") > 0)
           .select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct())
    rows = _with_row(docs, "doc_id").withColumn("digest", F.xxhash64("row.text"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")),
                     "left_anti").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows the text.

    No row goes; null and empty texts, and all other columns, are as they came. Repeated rows are
    covered alike. An empty table stays empty.
    """
    ready(spark)
    return redact(docs, personal_data(docs.select("doc_id", "text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document by the mix, numbered by `copy` from 1.

    Adds size, source_size, target, copies, taken and copy, which replace input columns of these
    names. Null and empty texts have size 0; a null source is a source; rows that share a
    doc_id, also a null one, are taken alike. Rows that the mix does not take go. An empty
    table stays empty.
    """
    ready(spark)
    added = ["size", "source_size", "target", "copies", "taken", "copy"]
    mixed = mixture(_with_row(docs, "doc_id", "text", "source")).filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return mixed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added), *added)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group),
          ("decontamination", keep_uncontaminated), ("personal_data", redact_personal_data),
          ("mixing", mix_sources)]

# classifiers, signatures and redaction are beyond SQL; tests hold runs against planted cases
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = snapshot(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
