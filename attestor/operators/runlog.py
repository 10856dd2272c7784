"""Issues and counters of runs, kept as rows of a log keyed by run_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale


def route_issues(log: DataFrame) -> DataFrame:
    """Give each issue its severity and level.

    A given severity stands; otherwise the error class decides, and an unknown class is
    CRITICAL. CRITICAL and HIGH are errors, the others warnings. Unless given, an issue is
    recoverable if it is not CRITICAL.
    """
    classes = scale.dimension(log, list(fixed.ERROR_SEVERITY.items()), ["error_class", "_default"])
    severity = F.coalesce("severity", "_default", F.lit("CRITICAL"))
    return (log.join(classes, "error_class", "left").withColumn("severity", severity).drop("_default")
            .withColumns({"level": F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").otherwise("warning"),
                          "recoverable": F.coalesce("recoverable", F.col("severity") != "CRITICAL")}))


def issue_summary(routed: DataFrame) -> DataFrame:
    """Issues per run: by severity, by class, and in all ('ALL'), with two flags."""
    error = F.col("level") == "error"
    return (routed.withColumns({"_severity": F.col("severity")})
            .groupingSets([["run_id", "severity"], ["run_id", "error_class"], ["run_id"]],
                          "run_id", "severity", "error_class")
            .agg(F.count_if(error).alias("n_errors"), F.count_if(~error).alias("n_warnings"),
                 F.bool_or(F.col("_severity") == "CRITICAL").alias("has_critical"),
                 F.bool_or(error & F.col("recoverable")).alias("has_recoverable"))
            .withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ["severity", "error_class"]}))


def should_continue(routed: DataFrame) -> DataFrame:
    """Whether a run may go on: no critical and no unrecoverable error."""
    stops = (F.col("level") == "error") & ((F.col("severity") == "CRITICAL") | ~F.col("recoverable"))
    return routed.groupBy("run_id").agg((~F.bool_or(stops)).alias("should_continue"))


def run_counters(entries: DataFrame) -> DataFrame:
    """Counters per run from its log entries (run_id, entry)."""
    entry = F.col("entry")
    return entries.groupBy("run_id").agg(
        F.count_if(entry == "warning").alias("warnings"),
        F.count_if(entry.isin("error", "silent_failure")).alias("errors"),
        F.count_if(entry == "type_transformation").alias("transformations"),
        F.count_if(entry.isin("constraint_drop", "feature_drop")).alias("dropped_items"))
