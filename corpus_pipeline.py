"""A corpus pipeline: quality, repeated lines, near-duplicates, contamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of ``documents``; the last returns the mixture. Every result is written and read back
before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import decontaminate, linededup, mixing, neardup, quality
from attestor.llm.common import stored, table
from attestor.session import drop_scratch, scratch_mark

NEAR = neardup.Rule(words=5, number=80, part=100)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, each row by its own text.

    Texts without words are rejected, long ones are scored whole, equal texts score alike; rows
    without a doc_id are judged like others but do not train.
    """
    return quality.kept(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document may end up empty and stays.

    A null text becomes an empty one; rows with equal doc_ids count as one document, rows without
    one rank last.
    """
    return linededup.deduplicate_rows(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest doc_id; they link at 0.8 of 5 words.

    Rows are told apart by a 64-bit hash of all their columns, not by doc_id: rows without a
    doc_id take part and rank last, rows that share one are judged by their own texts, and of
    equal rows one stays. Documents without words link with nothing and stay, equal rows as one.
    """
    row = F.xxhash64(*COLUMNS)
    found = stored(neardup.near_duplicates(docs.select(row.alias("doc_id"), "text"), rule=NEAR)
                   .groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("n")), "near-rows")
    keys = docs.select(row.alias("row"), "doc_id").distinct()
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(neardup.NO_ID)), "row")).alias("first")
    best = stored(found.join(keys, "row").groupBy("component").agg(first).select(F.col("first.row").alias("row"))
                  .join(found.select("row", "n"), "row"), "near-best")
    kept = docs.select(*COLUMNS, row.alias("row"))
    once = kept.join(best.filter("n = 1").select("row"), "row", "left_semi")
    repeated = kept.join(best.filter("n > 1").select("row"), "row", "left_semi").dropDuplicates(["row"])
    return once.unionByName(repeated).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which at least a twentieth of the words are benchmark passages go, each row by its own text.

    A text without words is never contaminated.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed to the target weights: a row for each document and epoch.

    The rows name documents; ``docs`` of the stage before holds their texts. Nulls in lang or source are
    leaves of their own, a document without words takes no budget, ties are ordered by a seeded
    hash, equal rows are so many documents.
    """
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

# the classifier is trained, which SQL cannot say; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage wrote on its way goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, mark)
    return docs
