"""One query per operator over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.llm import (chat, decontaminate, linededup, mixing, neardup, periodic, pii, quality, rules, toxicity,
                          urlfilter, warc, whitening)
from attestor.llm import oracle_sql as sql
from attestor.llm.common import table
from attestor.llm.registry import query


@query("op1_pii")
def op1(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


@query("op2_line_dedup", sql.LINE_DEDUP)
def op2(spark, sf_dir):
    return linededup.digest(table(spark, sf_dir, "documents"))


@query("op3_decontaminate", sql.DECONTAMINATE)
def op3(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"))


@query("op5_warc", sql.WARC)
def op5(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


@query("op6_chat", sql.CHAT)
def op6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(rows.unionByName(more))


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_near_duplicates", sql.NEAR_DUPLICATES)
def op8(spark, sf_dir):
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query("op9_mixing", sql.MIXING)
def op9(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_rules", sql.RULES)
def op10(spark, sf_dir):
    return rules.digest(table(spark, sf_dir, "documents"))


@query("op11_url_filter", sql.URL_FILTER)
def op11(spark, sf_dir):
    return urlfilter.judged(table(spark, sf_dir, "pages"))


@query("op12_periodic_runs", sql.PERIODIC_RUNS)
def op12(spark, sf_dir):
    return periodic.digest(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
