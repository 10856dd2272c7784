"""Tables of the loss report, per schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.functions import quality
from attestor.operators.metrics import ELEMENTS

KEY = ["schema_id"]


def warning_categories(warnings: DataFrame) -> DataFrame:
    """Warnings by source."""
    return warnings.groupBy(*KEY, "source").agg(F.count("*").alias("n_warnings"))


def reason_examples(log: DataFrame, first: int = 3) -> DataFrame:
    """Type changes by reason: how many, the first few, and how many more."""
    return scale.first_rows_and_total(log, [*KEY, "reason"], ["table_name", "column_name"], first)


def by_original_type(log: DataFrame) -> DataFrame:
    """Type changes by old type: number of columns and the distinct new types.

    An old type has two new ones at most, as an enum of the schema and otherwise.
    """
    return log.groupBy(*KEY, "original_type").agg(
        F.count("*").alias("n_columns"), F.array_sort(F.collect_set("new_type")).alias("new_types"))


def array_examples(log: DataFrame, first: int = 10) -> DataFrame:
    """Changes of array types: how many, and the first few."""
    arrays = log.filter(F.contains("original_type", F.lit("[]")))
    return scale.first_rows_and_total(arrays, KEY, ["table_name", "column_name"], first)


def failure_examples(failures: DataFrame, first: int = 5) -> DataFrame:
    """Silent failures by severity: how many, the first few, and how many more."""
    return scale.first_rows_and_total(failures, [*KEY, "severity"], ["description", "type"], first)


def failures_by_type(failures: DataFrame) -> DataFrame:
    return failures.groupBy(*KEY, "type").agg(F.count("*").alias("n_failures"))


def drop_examples(drops: DataFrame, first: int = 5) -> DataFrame:
    """Dropped constraints by kind with the reason: how many, and the first few."""
    return scale.first_rows_and_total(drops, [*KEY, "kind"], ["table_name", "constraint_name"], first)


def feature_examples(routed: DataFrame, first: int = 2) -> DataFrame:
    """Features by action and type: how many, and the impact of the first few."""
    impacts = scale.dimension(routed, list(fixed.FEATURE_IMPACT.items()), ["feature_type", "impact"])
    return scale.first_rows_and_total(routed, [*KEY, "action", "feature_type"], ["location"], first).join(
        impacts, "feature_type", "left")


def report_advice(metrics: DataFrame, log: DataFrame, drops: DataFrame) -> DataFrame:
    """Recommendations by what was found; ``metrics`` has sigma_level and features_dropped."""
    counts = scale.tally(
        KEY, (metrics, {"_low": F.col("sigma_level") < 4, "_features": F.col("features_dropped") > 0}),
        (log, {"_arrays": F.contains("original_type", F.lit("[]"))}),
        (drops, {"_checks": F.col("kind") == "CHECK"}))
    given = scale.rules(*[(F.col(c) > 0, F.lit(fixed.REPORT_ADVICE[k])) for c, k in [
        ("_low", "low_sigma"), ("_features", "dropped_features"), ("_arrays", "array_types"), ("_checks", "dropped_checks")]])
    lines = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(fixed.NO_REPORT_ADVICE)))
    return counts.select(*KEY, F.explode(lines).alias("advice"))


def executive_summary(metrics: DataFrame) -> DataFrame:
    """Level, grade, score and three statuses."""
    sigma = F.col("sigma_level")
    return metrics.select(
        *KEY, "sigma_level", quality.grade(sigma, F.col("compatibility")).alias("grade"), "compatibility", "failures",
        F.when(F.col("compatibility") > 0.9, "achieved").otherwise("issues").alias("parser_status"),
        F.when(F.col("failures") == 0, "none").otherwise("documented").alias("silent_status"),
        F.when(sigma >= 6, "six sigma").when(sigma >= 4, "target met").otherwise("issues").alias("quality_status"))


def statistics_long(statistics: DataFrame) -> DataFrame:
    """Before, after and rate: one row per kind of element."""
    rows = [F.struct(F.lit(e).alias("element"), F.col(f"{e}_before").alias("n_before"),
                     F.col(f"{e}_after").alias("n_after"), F.col(f"{e}_rate").alias("rate")) for e in ELEMENTS]
    return statistics.select(*KEY, F.inline(F.array(*rows)))


def overview(warnings: DataFrame, log: DataFrame, dropped: DataFrame, drops: DataFrame,
             repairs: DataFrame, issues: DataFrame) -> DataFrame:
    """Totals of everything that was done, from one grouping."""
    one = scale.one()
    return scale.tally(KEY, (warnings, {"n_warnings": one}), (log, {"n_transformations": one}),
                       (dropped, {"n_features_dropped": one}), (drops, {"n_constraints_dropped": one}),
                       (repairs, {"n_repairs": one}), (issues, {"n_issues": one}))
