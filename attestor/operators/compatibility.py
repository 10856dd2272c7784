"""Issues that keep a catalog from being drawn, their score and advice.

An issue has the form schema_id, issue_type, severity, subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.functions import quality
from attestor.functions.names import PLAIN_NAME
from attestor.operators.catalog import primary_keys
from attestor.operators.relations import has_cascade
from attestor.sources.catalog import Catalog

ISSUE = ["schema_id", "issue_type", "severity", "subject"]
TABLE = ["schema_id", "table_name"]


def _issues(df: DataFrame, subject: Column, *cases: tuple[Column, str, str]) -> DataFrame:
    found = F.explode(scale.rules(*[
        (condition, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity")))
        for condition, kind, severity in cases]))
    return (df.select("schema_id", subject.alias("subject"), found.alias("i"))
            .select("schema_id", "i.issue_type", "i.severity", "subject"))


def _column() -> Column:
    return F.concat_ws(".", "table_name", "column_name")


def name_issues(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Invalid, reserved and very long names."""
    name = F.col("column_name")
    return _issues(tables, F.col("table_name"),
                   (~F.col("table_name").rlike(PLAIN_NAME), "INVALID_TABLE_NAME", "HIGH")).unionByName(
        _issues(columns, _column(),
                (~name.rlike(PLAIN_NAME), "INVALID_COLUMN_NAME", "HIGH"),
                (F.lower(name).isin(fixed.DIAGRAM_WORDS), "RESERVED_KEYWORD", "MEDIUM"),
                (F.length(name) > fixed.LONG_COLUMN_NAME, "LONG_COLUMN_NAME", "LOW")))


def no_key_issues(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Tables without key columns."""
    without = tables.join(keys.select(*TABLE).distinct(), TABLE, "left_anti")
    return _issues(without, F.col("table_name"), (F.lit(True), "NO_PRIMARY_KEY", "MEDIUM"))


def complex_type_issues(columns: DataFrame) -> DataFrame:
    """Arrays, types with several parameters and quoted types."""
    return _issues(columns, _column(),
                   (F.col("data_type").rlike(r'\[\]|\(.*,.*\)|^".*"\z'), "COMPLEX_DATA_TYPE", "MEDIUM"))


def relationship_issues(relationships: DataFrame) -> DataFrame:
    """Composite, self-referencing and cascading relationships; one may be all three."""
    return _issues(
        relationships, F.concat_ws(" -> ", "source_table", "target_table"),
        (F.size("source_columns") > 1, "COMPOSITE_RELATIONSHIP", "HIGH"),
        (F.col("source_table") == F.col("target_table"), "SELF_REFERENCING", "MEDIUM"),
        (has_cascade(), "CASCADE_ACTION_INVISIBLE", "MEDIUM"))


def all_issues(catalog: Catalog) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        name_issues(catalog.tables, catalog.columns),
        no_key_issues(catalog.tables, primary_keys(catalog.columns, catalog.constraints)),
        complex_type_issues(catalog.columns), relationship_issues(catalog.relationships)])


def issue_score(issues: DataFrame, schemas: DataFrame) -> DataFrame:
    """Score per schema by weighted issues; a schema without issues scores 1."""
    severity = F.col("severity")
    counts = scale.tally(
        ["schema_id"], (schemas, {}),
        (issues, {"n_issues": scale.one(), "n_high": severity == "HIGH",
                  "_weight": F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).otherwise(1)}))
    most = F.greatest(F.col("n_issues") * 3, F.lit(10))
    return counts.select("schema_id", "n_issues", "n_high",
                         F.greatest(F.lit(0.0), 1 - F.col("_weight") / most).alias("score"))


def recommendations(issues: DataFrame, schemas: DataFrame) -> DataFrame:
    """Advice for the kinds of issue a schema has, or one line if there is none."""
    counts = scale.tally(
        ["schema_id"], (schemas, {}),
        (issues, {k: F.col("issue_type") == k for k in fixed.COMPATIBILITY_ADVICE}))
    given = scale.rules(*[(F.col(k) > 0, F.lit(v)) for k, v in fixed.COMPATIBILITY_ADVICE.items()])
    lines = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(fixed.NO_ADVICE)))
    return counts.select("schema_id", F.explode(lines).alias("advice"))


def score_grade(scores: DataFrame) -> DataFrame:
    return scores.select("schema_id", "n_high", quality.score_grade(F.col("score")).alias("grade"))


def limit_issues(catalog: Catalog) -> DataFrame:
    """Names beyond the identifier limit and relationships of too many columns."""
    def too_long(df: DataFrame, name: str, kind: str) -> DataFrame:
        return (df.filter(F.length(name) > fixed.MAX_IDENTIFIER)
                .select("schema_id", F.lit(kind).alias("kind"), F.col(name).alias("subject"),
                        F.length(name).alias("size")))

    wide = catalog.relationships.filter(F.size("source_columns") > fixed.MAX_RELATIONSHIP_COLUMNS).select(
        "schema_id", F.lit("relationship columns").alias("kind"),
        F.concat_ws(" -> ", "source_table", "target_table").alias("subject"),
        F.size("source_columns").alias("size"))
    return reduce(DataFrame.unionByName, [
        too_long(catalog.tables, "table_name", "table name"),
        too_long(catalog.columns, "column_name", "column name"),
        too_long(catalog.constraints, "constraint_name", "constraint name"), wide])
