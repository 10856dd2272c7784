"""Quality metrics of a conversion, one row per schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.functions import quality
from attestor.sources.catalog import Catalog

KEY = ["schema_id"]
ELEMENTS = ["tables", "columns", "relationships", "constraints"]


def _element_counts(catalog: Catalog, suffix: str) -> list[tuple[DataFrame, dict[str, Column]]]:
    return [(getattr(catalog, e), {f"{e}_{suffix}": scale.one()}) for e in ELEMENTS]


def conversion_statistics(a: Catalog, b: Catalog) -> DataFrame:
    """For each kind of element: number before, number after, and their rate."""
    counts = scale.tally(KEY, *_element_counts(a, "before"), *_element_counts(b, "after"))
    return counts.withColumns({
        f"{e}_rate": quality.rate(F.col(f"{e}_after"), F.col(f"{e}_before")) for e in ELEMENTS})


def opportunities(a: Catalog) -> DataFrame:
    """Elements that could fail."""
    counts = scale.tally(KEY, *_element_counts(a, "before"))
    return counts.select(*KEY, sum(F.col(f"{e}_before") for e in ELEMENTS).alias("opportunities"))


def _expects_warning() -> Column:
    return F.lower("data_type").rlike("|".join(fixed.EXPECTED_LOSS_WORDS))


def expected_warnings(a: Catalog) -> DataFrame:
    """Warnings the source should raise: its check constraints and its columns of lossy types."""
    return scale.tally(
        KEY, (a.tables, {}),
        (a.constraints, {"expected": F.col("constraint_type") == "c"}),
        (a.columns, {"expected": _expects_warning()}))


_STANDARD = " OR ".join(
    f"(contains(lower(original_type), '{old}') AND contains(lower(new_type), '{new}'))"
    for old, new in fixed.STANDARD_CHANGES)


def _is_unexpected_change() -> Column:
    """Whether a logged type change loses meaning; parts of names are compared, not whole names."""
    return F.expr(f"lower(original_type) <> lower(new_type) AND NOT ({_STANDARD})")


def expected_from_log(log: DataFrame, dropped: DataFrame) -> DataFrame:
    """Warnings the result should carry: unusual type changes and dropped features."""
    return scale.tally(KEY, (log, {"expected": _is_unexpected_change()}), (dropped, {"expected": scale.one()}))


def defects(failures: DataFrame, lint: DataFrame, warnings: DataFrame, casts: DataFrame,
            a: Catalog) -> DataFrame:
    """Defects by severity and their weighted total; schemas without any have zeros.

    ``lint`` holds syntax errors, ``casts`` failed conversions, one row each.
    """
    severity = F.col("severity")
    counts = scale.tally(
        KEY,
        (a.tables, {}),
        (failures, {"critical": severity == "CRITICAL", "high": severity == "HIGH",
                    "medium": ~severity.isin("CRITICAL", "HIGH")}),
        (lint, {"critical": scale.one()}),
        (casts, {"medium": scale.one()}),
        (warnings, {"_actual": scale.one()}),
        (a.constraints, {"_expected": F.col("constraint_type") == "c"}),
        (a.columns, {"_expected": _expects_warning()}))
    lacking = F.least(F.greatest(F.col("_expected") - F.col("_actual"), F.lit(0)), F.lit(2))
    high = F.col("high") + lacking
    return counts.select(
        *KEY, "critical", high.alias("high"), "medium",
        (F.col("critical") * 3 + high * 2 + F.col("medium")).alias("defects"))


def preservation_of(after, before) -> dict[str, Column]:
    """Shares of tables, relationships and constraints kept, and their weighted mean."""
    kept = {e: F.least(F.lit(1.0), quality.rate(after(e), before(e)))
            for e in ["tables", "relationships", "constraints"]}
    mean = (kept["tables"] * 3 + kept["relationships"] * 5 + kept["constraints"] * 4) / 12
    return {**{f"{e}_preservation": c for e, c in kept.items()}, "semantic_preservation": mean}


def preservation(statistics: DataFrame) -> DataFrame:
    found = preservation_of(lambda e: F.col(f"{e}_after"), lambda e: F.col(f"{e}_before"))
    return statistics.select(*KEY, *[c.alias(n) for n, c in found.items()])


def compatibility_of(errors: Column, actual: Column, expected: Column, changes: Column,
                     failures: Column) -> dict[str, Column]:
    """Syntax, completeness of warnings, silent losses, and their weighted mean."""
    syntax = F.greatest(F.lit(0.0), 1.0 - errors * 0.1)
    share = F.least(F.lit(1.0), actual / F.greatest(expected, F.lit(1)))
    completeness = (F.when(changes == 0, share).when(expected == 0, F.lit(1.0))
                    .otherwise(F.greatest(share, F.lit(0.8))))
    silent = F.greatest(F.lit(0.0), 1.0 - failures * 0.05)
    return {"syntax_score": syntax, "warning_completeness": completeness, "silent_score": silent,
            "compatibility": syntax * 0.5 + completeness * 0.3 + silent * 0.2}


def compatibility(a: Catalog, lint: DataFrame, warnings: DataFrame, log: DataFrame,
                  dropped: DataFrame, failures: DataFrame) -> DataFrame:
    """Compatibility of the result, one row per schema."""
    one = scale.one()
    counts = scale.tally(
        KEY, (a.tables, {}), (lint, {"errors": one}), (warnings, {"actual": one}),
        (log, {"expected": _is_unexpected_change(), "changes": one}), (dropped, {"expected": one}),
        (failures, {"failures": one}))
    found = compatibility_of(*[F.col(n) for n in ["errors", "actual", "expected", "changes", "failures"]])
    return counts.select(*KEY, *[c.alias(n) for n, c in found.items()])


def prevention(failures: DataFrame, a: Catalog) -> DataFrame:
    """How well silent losses were prevented."""
    counts = scale.tally(KEY, *_element_counts(a, "before"), (failures, {"failures": scale.one()}))
    total = sum(F.col(f"{e}_before") for e in ELEMENTS)
    return counts.select(*KEY, (1.0 - quality.rate(F.col("failures"), total)).alias("prevention"))


def gate_of(tables_rate: Column, columns_rate: Column, failures: Column, score: Column) -> Column:
    return (tables_rate >= 1) & (columns_rate >= 1) & (failures == 0) & (score >= 0.8)


def quality_metrics(a: Catalog, b: Catalog, failures: DataFrame, warnings: DataFrame,
                    log: DataFrame, dropped: DataFrame, lint: DataFrame, casts: DataFrame) -> DataFrame:
    """Every metric of a conversion from one grouping over all its records."""
    one = scale.one()
    severity = F.col("severity")
    counts = scale.tally(
        KEY,
        *_element_counts(b, "after"),
        (a.tables, {"tables_before": one}),
        (a.columns, {"columns_before": one, "_source_expected": _expects_warning()}),
        (a.relationships, {"relationships_before": one}),
        (a.constraints, {"constraints_before": one, "_source_expected": F.col("constraint_type") == "c"}),
        (failures, {"failures": one, "_critical": severity == "CRITICAL", "_high": severity == "HIGH",
                    "_medium": ~severity.isin("CRITICAL", "HIGH")}),
        (warnings, {"total_warnings": one}),
        (log, {"types_converted": one, "_expected": _is_unexpected_change()}),
        (dropped, {"features_dropped": one, "_expected": one}),
        (lint, {"syntax_errors": one}),
        (casts, {"failed_casts": one}))
    lacking = F.least(F.greatest(F.col("_source_expected") - F.col("total_warnings"), F.lit(0)), F.lit(2))
    counts = counts.withColumns({
        "critical": F.col("_critical") + F.col("syntax_errors"),
        "high": F.col("_high") + lacking,
        "medium": F.col("_medium") + F.col("failed_casts"),
        "opportunities": sum(F.col(f"{e}_before") for e in ELEMENTS),
        **{f"{e}_rate": quality.rate(F.col(f"{e}_after"), F.col(f"{e}_before")) for e in ELEMENTS}})
    counts = counts.withColumn("defects", F.col("critical") * 3 + F.col("high") * 2 + F.col("medium"))
    counts = counts.withColumn("dpmo", quality.dpmo(F.col("defects"), F.col("opportunities")))
    scored = counts.withColumns({
        "sigma_level": quality.sigma(F.col("dpmo")),
        "prevention": 1.0 - quality.rate(F.col("failures"), F.col("opportunities")),
        **preservation_of(lambda e: F.col(f"{e}_after"), lambda e: F.col(f"{e}_before")),
        **compatibility_of(F.col("syntax_errors"), F.col("total_warnings"), F.col("_expected"),
                           F.col("types_converted"), F.col("failures"))})
    return scored.withColumns({
        "grade": quality.grade(F.col("sigma_level"), F.col("compatibility")),
        "passed": gate_of(F.col("tables_rate"), F.col("columns_rate"), F.col("failures"),
                          F.col("compatibility"))}).drop(
        *[c for c in counts.columns if c.startswith("_")])


def gate(metrics: DataFrame) -> DataFrame:
    """Whether each conversion passes; the caller decides what to do about it."""
    passed = gate_of(F.col("tables_rate"), F.col("columns_rate"), F.col("failures"), F.col("compatibility"))
    return metrics.select(*KEY, passed.alias("passed"))
