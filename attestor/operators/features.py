"""Database features that a diagram cannot hold, found in a catalog.

A feature has the form schema_id, feature_type, severity, location, data_type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.operators.catalog import organize_columns, organize_relationships
from attestor.sources.catalog import Catalog

FEATURE = ["schema_id", "feature_type", "severity", "location", "data_type"]


def _feature(kind: str, severity: str) -> Column:
    return F.struct(F.lit(kind).alias("feature_type"), F.lit(severity).alias("severity"))


def _features(df: DataFrame, location: Column, *cases: tuple[Column, str, str],
              data_type: Column | None = None) -> DataFrame:
    """All rules over a record set in one pass; a record may have several features."""
    found = F.explode(scale.rules(*[(condition, _feature(kind, severity))
                                    for condition, kind, severity in cases]))
    return (df.select("schema_id", location.alias("location"),
                      (F.lit("") if data_type is None else data_type).alias("data_type"), found.alias("f"))
            .select("schema_id", "f.feature_type", "f.severity", "location", "data_type"))


def _mentions(text: str, word: str) -> Column:
    return F.contains(F.upper(text), F.lit(word))


def _part(first: str, second: str) -> Column:
    return F.concat(F.col(first), F.lit("."), F.coalesce(second, F.lit("unnamed")))


def column_features(columns: DataFrame) -> DataFrame:
    """Arrays, generated uuid defaults and negative defaults of organized columns."""
    return _features(
        columns, _part("table_name", "column_name"),
        (F.col("is_array"), "ARRAY_TYPE", "CRITICAL"),
        (F.contains("default_value", F.lit("gen_random_uuid()")), "UUID_FUNCTION", "HIGH"),
        (F.col("default_value").rlike(r"^-[0-9]+\z"), "NEGATIVE_DEFAULT", "MEDIUM"),
        data_type=F.col("data_type"))


def type_features(columns: DataFrame) -> DataFrame:
    """Columns whose base type belongs to a family without a counterpart."""
    families = scale.dimension(columns, fixed.TYPE_FEATURES, ["_type", "feature_type", "severity"])
    return (columns.withColumn("_type", F.lower("base_type")).join(families, "_type")
            .withColumn("location", _part("table_name", "column_name")).select(*FEATURE))


def table_features(tables: DataFrame) -> DataFrame:
    """Inheritance and partitioning."""
    partitioned = _mentions("original_statement", "PARTITION BY") | _mentions("original_statement", "PARTITION OF")
    return _features(tables, F.col("table_name"),
                     (_mentions("original_statement", "INHERITS"), "TABLE_INHERITANCE", "CRITICAL"),
                     (partitioned, "TABLE_PARTITIONING", "CRITICAL"))


def constraint_features(constraints: DataFrame) -> DataFrame:
    return _features(
        constraints, _part("table_name", "constraint_name"),
        (F.col("constraint_type") == "c", "CHECK_CONSTRAINT", "HIGH"),
        (_mentions("definition", "DEFERRABLE"), "DEFERRABLE_CONSTRAINT", "HIGH"),
        (F.startswith(F.upper("definition"), F.lit("EXCLUDE")), "EXCLUDE_CONSTRAINT", "CRITICAL"))


def index_features(indexes: DataFrame) -> DataFrame:
    definition = F.col("definition")
    return _features(
        indexes, _part("table_name", "index_name"),
        (_mentions("definition", "WHERE"), "PARTIAL_INDEX", "HIGH"),
        (definition.rlike(r"\([^)]*\([^)]*\)[^)]*\)"), "EXPRESSION_INDEX", "HIGH"),
        (_mentions("definition", "CONCURRENTLY"), "CONCURRENT_INDEX", "MEDIUM"),
        (definition.rlike(r"[\p{L}\p{N}_]_ops"), "OPERATOR_CLASS", "HIGH"))


def relationship_features(relationships: DataFrame) -> DataFrame:
    """Cascades and composite keys of organized relationships."""
    location = F.concat_ws(" -> ", "source_table", "target_table")
    cascades = F.coalesce(F.col("on_delete") == "CASCADE", F.lit(False)) | (F.col("on_update") == "CASCADE")
    return _features(relationships, location, (cascades, "CASCADE_ACTION", "MEDIUM"),
                     (F.col("is_composite"), "COMPOSITE_FOREIGN_KEY", "HIGH"))


def detect_features(catalog: Catalog) -> DataFrame:
    """The features of all record sets; HIGH and CRITICAL ones are issues."""
    columns = organize_columns(catalog.columns)
    found = reduce(DataFrame.unionByName, [
        column_features(columns), type_features(columns), table_features(catalog.tables),
        constraint_features(catalog.constraints), index_features(catalog.indexes),
        relationship_features(organize_relationships(catalog.relationships))])
    return found.withColumn("is_issue", F.col("severity").isin("HIGH", "CRITICAL"))


def feature_summary(features: DataFrame) -> DataFrame:
    """Counts per schema: by severity, by type and in all; 'ALL' marks what is summed up."""
    return (features.groupingSets([["schema_id", "severity"], ["schema_id", "feature_type"], ["schema_id"]],
                                  "schema_id", "severity", "feature_type")
            .agg(F.count("*").alias("n_features"))
            .withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ["severity", "feature_type"]}))


def critical(features: DataFrame) -> DataFrame:
    return features.filter("severity = 'CRITICAL'")


_HANDLED = ["ARRAY_TYPE", "CHECK_CONSTRAINT", "CASCADE_ACTION", "GEOMETRIC_TYPE", "NETWORK_TYPE", "RANGE_TYPE"]
_LOST = ["TABLE_INHERITANCE", "TABLE_PARTITIONING"]


def route_features(features: DataFrame) -> DataFrame:
    """Mark each feature as processed or dropped."""
    kind = F.col("feature_type")
    action = (F.when(kind.isin(_LOST), "DROPPED").when(kind.isin(_HANDLED), "PROCESSED")
              .when(F.col("severity") == "CRITICAL", "DROPPED").otherwise("PROCESSED"))
    return features.withColumn("action", action)


def feature_notes(routed: DataFrame) -> DataFrame:
    """A note for each feature, and warnings for cascades and for all that is dropped.

    Inheritance and partitioning warn twice: for the drop and for what to do instead.
    """
    kind, place = F.col("feature_type"), F.col("location")
    dropped = F.col("action") == "DROPPED"
    note = (F.when(kind == "ARRAY_TYPE", F.lit("array type kept with quotes"))
            .when(kind == "CHECK_CONSTRAINT", F.lit("CHECK constraint dropped with a warning"))
            .when(kind == "CASCADE_ACTION", F.format_string("CASCADE action at %s kept but not visible", place))
            .when(kind.isin("GEOMETRIC_TYPE", "NETWORK_TYPE", "RANGE_TYPE"),
                  F.format_string("%s '%s' at %s converted to text", kind, "data_type", place))
            .when(kind == "TABLE_INHERITANCE", F.format_string("table inheritance of '%s' lost", place))
            .when(kind == "TABLE_PARTITIONING", F.format_string("table partitioning of '%s' lost", place))
            .when(dropped, F.format_string("%s at %s not supported", kind, place))
            .otherwise(F.format_string("%s at %s handled with limitations", kind, place)))

    def entry(what: str, text: Column) -> Column:
        return F.struct(F.lit(what).alias("entry"), text.alias("text"))

    entries = scale.rules(
        (F.lit(True), entry("note", F.col("_note"))),
        (kind == "CASCADE_ACTION", entry("warning", F.format_string("CASCADE action at %s is hidden in diagrams", place))),
        (dropped, entry("warning", F.format_string("Dropped %s at %s: %s", kind, place, "_note"))),
        (kind == "TABLE_INHERITANCE", entry("warning", F.format_string("Flatten or document the inheritance of '%s'", place))),
        (kind == "TABLE_PARTITIONING", entry("warning", F.format_string("Represent the partitions of '%s' as tables", place))))
    return (routed.withColumn("_note", note)
            .select("schema_id", "feature_type", "location", F.explode(entries).alias("e"))
            .select("schema_id", "feature_type", "location", "e.entry", "e.text"))


def feature_report(routed: DataFrame) -> DataFrame:
    """Processed and dropped features per schema and type, spread over the severities."""
    counts = routed.groupBy("schema_id", "action", "feature_type").pivot(
        "severity", list(fixed.SEVERITY_RANK)).count()
    return counts.select("schema_id", "action", "feature_type",
                         *[F.coalesce(s, F.lit(0)).alias(f"n_{s.lower()}") for s in fixed.SEVERITY_RANK])


def with_decision(features: DataFrame) -> DataFrame:
    """The features that need a decision, with its name."""
    needed = scale.dimension(features, list(fixed.FEATURE_DECISION.items()), ["feature_type", "decision"])
    return features.join(needed, "feature_type")


def decision_groups(features: DataFrame, first: int = 5) -> DataFrame:
    """Per schema and decision: number of features, the first few, and how many more."""
    return scale.first_rows_and_total(with_decision(features), ["schema_id", "decision"],
                                      ["location", "feature_type"], first)


def decisions(schemas: DataFrame, features: DataFrame, overrides: DataFrame) -> DataFrame:
    """The six decisions of every schema.

    A choice (schema_id, decision, choice) replaces the default where the schema has a
    feature that asks for it.
    """
    defaults = F.create_map(*[F.lit(x) for pair in fixed.DEFAULT_DECISIONS.items() for x in pair])
    every = schemas.select("schema_id").distinct().select("schema_id", F.explode(defaults).alias("decision", "default"))
    keys = ["schema_id", "decision"]
    asked = with_decision(features).select(*keys).distinct()
    chosen = overrides.join(asked, keys, "left_semi")
    return every.join(chosen, keys, "left").select(*keys, F.coalesce("choice", "default").alias("choice"))
