"""Enrichment and statistics of catalogs; every result is keyed by schema_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import scale
from attestor.functions import names
from attestor.sources.catalog import Catalog

TABLE = ["schema_id", "table_name"]


def organize_columns(columns: DataFrame) -> DataFrame:
    """Mark arrays and split each type into base and parameters."""
    t = F.col("data_type")
    return columns.withColumns({"is_array": names.is_array(t), "base_type": names.base_type(t),
                                "type_parameters": names.type_parameters(t)})


def primary_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Key columns, declared at the column or at the table, each once."""
    at_column = columns.filter("is_primary_key").select(*TABLE, "column_name")
    at_table = (constraints.filter("constraint_type = 'p'")
                .select(*TABLE, F.explode("columns").alias("column_name")))
    return at_column.unionByName(at_table).distinct()


def has_primary_key(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Every table, with a flag whether it has key columns."""
    marked = keys.select(*TABLE).distinct().withColumn("_key", F.lit(True))
    return (tables.select(*TABLE).join(marked, TABLE, "left")
            .select(*TABLE, F.col("_key").isNotNull().alias("has_primary_key")))


def foreign_keys(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per table and outgoing reference; a table without one keeps a row of nulls."""
    outgoing = relationships.withColumnRenamed("source_table", "table_name")
    return (tables.select(*TABLE).join(outgoing, TABLE, "left")
            .select(*TABLE, "rel_no", "source_columns", "target_table", "target_columns",
                    "on_delete", "on_update"))


def organize_relationships(relationships: DataFrame) -> DataFrame:
    """Mark composite and self references; the type is many-to-one unless it is given."""
    declared = F.col("relationship_type") if "relationship_type" in relationships.columns else F.lit(None)
    return relationships.withColumns({
        "is_composite": F.size("source_columns") > 1,
        "is_self_referencing": F.col("source_table") == F.col("target_table"),
        "relationship_type": F.coalesce(declared, F.lit("many-to-one"))})


def organize_indexes(indexes: DataFrame) -> DataFrame:
    return indexes.withColumns({"column_count": F.size("columns"),
                                "is_composite": F.size("columns") > 1})


def all_constraints(table_level: DataFrame, added: DataFrame) -> DataFrame:
    """Constraints of the tables and those added later."""
    return table_level.unionByName(added, allowMissingColumns=True)


def organize_tables(catalog: Catalog) -> DataFrame:
    """Every table with its numbers of columns and references and its sorted key columns.

    The counts come from one grouping. The key list is a set, so equal names combine before
    the shuffle, and its size is that of one declared key.
    """
    counts = scale.tally(
        TABLE,
        (catalog.tables, {"_tables": scale.one()}),
        (catalog.columns, {"column_count": scale.one()}),
        (catalog.relationships.withColumnRenamed("source_table", "table_name"),
         {"foreign_key_count": scale.one()}))
    keys = (primary_keys(catalog.columns, catalog.constraints).groupBy(*TABLE)
            .agg(F.array_sort(F.collect_set("column_name")).alias("key_columns")))
    return (counts.filter("_tables > 0").drop("_tables").join(keys, TABLE, "left")
            .withColumn("has_primary_key", F.col("key_columns").isNotNull())
            .withColumn("key_columns", F.coalesce("key_columns", F.array().cast("array<string>"))))


def inventory(enums: DataFrame, sequences: DataFrame) -> DataFrame:
    """Named enums with their values in order, and sequences."""
    return (enums.select("schema_id", F.lit("enum").alias("kind"),
                         F.col("enum_name").alias("name"), "values")
            .unionByName(sequences.select(
                "schema_id", F.lit("sequence").alias("kind"), F.col("sequence_name").alias("name"),
                F.array().cast("array<string>").alias("values"))))


def catalog_statistics(catalog: Catalog) -> DataFrame:
    """Ten counts per schema, from one grouping over all record sets."""
    one = scale.one()
    return scale.tally(
        ["schema_id"],
        (catalog.tables, {"total_tables": one}),
        (catalog.columns, {
            "total_columns": one,
            "array_columns": names.is_array(F.col("data_type")),
            "nullable_columns": F.coalesce("is_nullable", F.lit(True)),
            "primary_key_columns": F.coalesce("is_primary_key", F.lit(False))}),
        (catalog.relationships, {
            "total_relationships": one,
            "composite_relationships": F.size("source_columns") > 1,
            "self_referencing_relationships": F.col("source_table") == F.col("target_table")}),
        (catalog.indexes, {"total_indexes": one}),
        (catalog.constraints, {"total_constraints": one}))
