"""Queries: catalog model."""

from pyspark.sql import functions as F

from attestor.functions.names import listed
from attestor.operators import catalog as ops
from attestor.plans.registry import query

PK = """
  SELECT DISTINCT schema_id, table_name, column_name FROM (
    SELECT schema_id, table_name, column_name FROM f_columns WHERE is_primary_key
    UNION ALL SELECT schema_id, table_name, columns FROM f_constraints WHERE constraint_type = 'p') u"""


@query("cat_columns", """
  SELECT schema_id, table_name, ordinal, column_name, data_type, data_type LIKE '%[]%' AS is_array,
    CASE WHEN data_type LIKE '%(%' THEN split_part(data_type, '(', 1) ELSE replace(data_type, '[]', '') END AS base_type,
    CASE WHEN data_type LIKE '%(%' THEN replace(split_part(data_type, '(', 2), ')', '') ELSE '' END AS type_parameters
  FROM f_columns""")
def cat_columns(i):
    return ops.organize_columns(i.views().columns).select(
        "schema_id", "table_name", "ordinal", "column_name", "data_type", "is_array", "base_type",
        F.coalesce("type_parameters", F.lit("")).alias("type_parameters"))


@query("cat_pk", "SELECT * FROM pk", pk=PK)
def cat_pk(i):
    c = i.catalog()
    return ops.primary_keys(c.columns, c.constraints)


@query("cat_has_pk", """
  SELECT schema_id, table_name, EXISTS (SELECT 1 FROM pk WHERE pk.schema_id = t.schema_id
    AND pk.table_name = t.table_name) AS has_primary_key FROM f_tables t""", pk=PK)
def cat_has_pk(i):
    c = i.catalog()
    return ops.has_primary_key(c.tables, ops.primary_keys(c.columns, c.constraints))


@query("cat_fks", """
  SELECT t.schema_id, t.table_name, coalesce(r.rel_no, -1) AS rel_no, coalesce(r.source_columns, '') AS source_columns,
    coalesce(r.target_table, '') AS target_table, coalesce(r.target_columns, '') AS target_columns,
    coalesce(r.on_delete, '') AS on_delete, coalesce(r.on_update, '') AS on_update
  FROM f_tables t LEFT JOIN f_relationships r ON r.schema_id = t.schema_id AND r.source_table = t.table_name""")
def cat_fks(i):
    c = i.catalog()
    none = F.lit("")
    return ops.foreign_keys(c.tables, c.relationships).select(
        "schema_id", "table_name", F.coalesce("rel_no", F.lit(-1)).alias("rel_no"),
        *[F.coalesce(listed(n) if n.endswith("columns") else F.col(n), none).alias(n)
          for n in ["source_columns", "target_table", "target_columns", "on_delete", "on_update"]])


@query("cat_rels", """
  SELECT schema_id, rel_no, source_table, target_table, source_columns LIKE '%,%' AS is_composite,
    source_table = target_table AS is_self_referencing, 'many-to-one' AS relationship_type
  FROM f_relationships""")
def cat_rels(i):
    return ops.organize_relationships(i.views().relationships).select(
        "schema_id", "rel_no", "source_table", "target_table", "is_composite",
        "is_self_referencing", "relationship_type")


@query("cat_indexes", """
  SELECT schema_id, table_name, index_name, columns,
    CAST(length(columns) - length(replace(columns, ',', '')) + 1 AS INTEGER) AS column_count,
    columns LIKE '%,%' AS is_composite FROM f_indexes""")
def cat_indexes(i):
    return ops.organize_indexes(i.views().indexes).select(
        "schema_id", "table_name", "index_name", listed("columns").alias("columns"),
        "column_count", "is_composite")


@query("cat_constraints", """
  SELECT schema_id, table_name, constraint_name, constraint_type, columns, definition FROM f_constraints""")
def cat_constraints(i):
    # foreign keys are the ones that dumps add by ALTER TABLE
    c = i.views().constraints
    both = ops.all_constraints(c.filter("constraint_type <> 'f'"), c.filter("constraint_type = 'f'"))
    return both.select("schema_id", "table_name", "constraint_name", "constraint_type",
                       listed("columns").alias("columns"), "definition")


@query("cat_tables", """
  SELECT t.schema_id, t.table_name,
    (SELECT count(*) FROM f_columns c WHERE c.schema_id = t.schema_id AND c.table_name = t.table_name) AS column_count,
    (SELECT count(*) FROM f_relationships r WHERE r.schema_id = t.schema_id AND r.source_table = t.table_name) AS foreign_key_count,
    coalesce(k.key_columns, '') AS key_columns, k.key_columns IS NOT NULL AS has_primary_key
  FROM f_tables t LEFT JOIN (SELECT schema_id, table_name, string_agg(column_name, ',' ORDER BY column_name) AS key_columns
    FROM pk GROUP BY ALL) k ON k.schema_id = t.schema_id AND k.table_name = t.table_name""", pk=PK)
def cat_tables(i):
    return ops.organize_tables(i.catalog()).select(
        "schema_id", "table_name", "column_count", "foreign_key_count",
        listed("key_columns").alias("key_columns"), "has_primary_key")


@query("cat_names", """
  SELECT schema_id, 'enum' AS kind, enum_name AS name, 'sad,ok,very happy' AS "values" FROM f_enums
  UNION ALL
  SELECT schema_id, 'sequence', table_name || '_' || column_name || '_seq', '' FROM f_columns
  WHERE data_type = 'bigserial'""")
def cat_names(i):
    c = i.views()
    return ops.inventory(c.enums, c.sequences).withColumn("values", listed("values"))


@query("cat_stats", """
  SELECT s.schema_id, s.total_tables, coalesce(c.total_columns, 0) AS total_columns,
    coalesce(c.array_columns, 0) AS array_columns, coalesce(c.nullable_columns, 0) AS nullable_columns,
    coalesce(c.primary_key_columns, 0) AS primary_key_columns, coalesce(r.n, 0) AS total_relationships,
    coalesce(r.composite, 0) AS composite_relationships, coalesce(r.self, 0) AS self_referencing_relationships,
    coalesce(x.n, 0) AS total_indexes, coalesce(k.n, 0) AS total_constraints
  FROM (SELECT schema_id, count(*) AS total_tables FROM f_tables GROUP BY 1) s
  LEFT JOIN (SELECT schema_id, count(*) AS total_columns, count(*) FILTER (data_type LIKE '%[]%') AS array_columns,
      count(*) FILTER (is_nullable) AS nullable_columns, count(*) FILTER (is_primary_key) AS primary_key_columns
    FROM f_columns GROUP BY 1) c USING (schema_id)
  LEFT JOIN (SELECT schema_id, count(*) AS n, count(*) FILTER (source_columns LIKE '%,%') AS composite,
      count(*) FILTER (source_table = target_table) AS self FROM f_relationships GROUP BY 1) r USING (schema_id)
  LEFT JOIN (SELECT schema_id, count(*) AS n FROM f_indexes GROUP BY 1) x USING (schema_id)
  LEFT JOIN (SELECT schema_id, count(*) AS n FROM f_constraints GROUP BY 1) k USING (schema_id)""")
def cat_stats(i):
    return ops.catalog_statistics(i.views())
