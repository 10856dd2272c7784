"""Queries: mentions in script text."""

from pyspark.sql import functions as F

from attestor.functions.names import listed
from attestor.operators import mentions as ops
from attestor.plans import sql_parts as sql
from attestor.plans.registry import query

# the fixture tells the lines of each statement and what they hold apart from comments
STATEMENTS = r"""
  SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY line_no) - 1 AS INTEGER) AS pos, statement, line_no
  FROM (SELECT script_id, head AS line_no, rtrim(string_agg(code || CASE WHEN remark = '' THEN '' ELSE ' ' END, chr(10) ORDER BY f.line_no), ';') AS statement
        FROM f_script f WHERE head IS NOT NULL GROUP BY 1, 2)"""
# the fixture writes every name in a form of its own; these are the names it means
TABLES = r"""
  SELECT script_id, pos, statement, CASE WHEN f.table_no % 4 = 2 AND line_no % 1000 = 0 THEN 'odd"' || f.table_name
      WHEN f.table_no % 4 = 1 AND line_no % 1000 = 0 THEN f.table_name
      ELSE regexp_extract(f.table_name, '^\w+') END AS table_name
  FROM statements s JOIN f_tables f ON f.schema_id = s.script_id AND f.table_no = s.line_no // 1000
  WHERE line_no % 1000 IN (0, 31)"""
KINDS = """
  SELECT *, CASE WHEN starts_with(upper(statement), 'CREATE TABLE') THEN 'CREATE TABLE'
    WHEN starts_with(upper(statement), 'ALTER TABLE') THEN 'ALTER TABLE' WHEN starts_with(upper(statement), 'CREATE INDEX') THEN 'CREATE INDEX'
    WHEN starts_with(upper(statement), 'CREATE SEQUENCE') THEN 'CREATE SEQUENCE'
    WHEN contains(upper(statement), 'CREATE TYPE') AND contains(upper(statement), 'ENUM') THEN 'CREATE ENUM' ELSE 'OTHER' END AS kind
  FROM statements"""
ADDED_CONSTRAINTS = r"""
  SELECT s.script_id, s.pos, regexp_extract(c.table_name, '^\w+') AS table_name, c.constraint_name, c.definition, c.constraint_type,
    CASE WHEN c.constraint_type = 'c' THEN '' ELSE c.columns END AS columns
  FROM statements s JOIN f_constraints c ON c.schema_id = s.script_id AND c.table_no = s.line_no // 1000
    AND CAST(substr(c.constraint_name, 3) AS BIGINT) = s.line_no % 1000 - 100
  WHERE s.line_no % 1000 BETWEEN 100 AND 199 AND c.constraint_type <> 'x' AND regexp_full_match(c.table_name, '\w+')"""
INDEXES = r"""
  SELECT s.script_id, s.pos, i.* EXCLUDE (schema_id, definition), s.statement
  FROM statements s JOIN f_indexes i ON i.schema_id = s.script_id
    AND i.index_name = 'ix_' || (s.line_no // 1000) || '_' || (s.line_no % 1000 - 200)
  WHERE s.line_no % 1000 BETWEEN 200 AND 299"""
S = dict(statements=STATEMENTS)


def scripts(i):
    return i.statements()


@query("ext_tables", "SELECT * FROM found_tables", **S, found_tables=TABLES)
def ext_tables(i):
    return ops.extract_tables(scripts(i))


@query("ext_first", """
  SELECT script_id, table_name, min(pos) AS pos FROM found_tables GROUP BY 1, 2""", **S, found_tables=TABLES)
def ext_first(i):
    return ops.first_definition(ops.extract_tables(scripts(i))).select("script_id", "table_name", "pos")


@query("ext_kind", "SELECT script_id, kind, count(*) AS n_statements FROM kinds GROUP BY 1, 2", **S, kinds=KINDS)
def ext_kind(i):
    return ops.statement_kinds(scripts(i))


@query("ext_flags", """
  SELECT script_id, pos, table_name, contains(upper(statement), 'PARTITION OF') AS is_partition,
    contains(upper(statement), 'INHERITS') AS inherits FROM found_tables""", **S, found_tables=TABLES)
def ext_flags(i):
    return ops.table_flags(ops.extract_tables(scripts(i))).drop("statement")


@query("ext_keys", """
  SELECT schema_id, table_name, constraint_name, constraint_type, columns FROM f_constraints WHERE constraint_type IN ('p', 'u')""")
def ext_keys(i):
    return ops.extract_keys(i.table("f_constraints").drop("columns", "constraint_type")).select(
        "schema_id", "table_name", "constraint_name", "constraint_type", listed("columns").alias("columns"))


@query("ext_checks", """
  SELECT schema_id, table_name, constraint_name, definition AS check_expression FROM f_constraints WHERE constraint_type = 'c'""")
def ext_checks(i):
    return ops.extract_checks(i.table("f_constraints")).select(
        "schema_id", "table_name", "constraint_name", "check_expression")


@query("ext_fks", """
  SELECT script_id, line_no, 'a' AS source_columns, split_part(line, ' ', 5) AS target_table, 'id' AS target_columns,
    'CASCADE' AS on_delete, '' AS on_update FROM f_lines WHERE line LIKE 'FOREIGN KEY%'
  UNION ALL SELECT schema_id, 0, columns, 'base', 'id', '', '' FROM f_constraints WHERE constraint_type = 'f'""")
def ext_fks(i):
    lines = i.table("f_lines").withColumnRenamed("line", "definition")
    declared = i.table("f_constraints").select(
        F.col("schema_id").alias("script_id"), F.lit(0).cast("long").alias("line_no"), "definition")
    none = F.lit("")
    return ops.extract_fks(lines.unionByName(declared)).select(
        "script_id", "line_no", listed("source_columns").alias("source_columns"), "target_table",
        listed("target_columns").alias("target_columns"), F.coalesce("on_delete", none).alias("on_delete"),
        F.coalesce("on_update", none).alias("on_update"))


@query("ext_names", """
  SELECT schema_id, table_name, constraint_name, definition AS body FROM f_constraints""")
def ext_names(i):
    named = i.table("f_constraints").withColumn(
        "definition", F.concat(F.lit(' CONSTRAINT "'), "constraint_name", F.lit('" '), "definition")).drop("constraint_name")
    return ops.extract_constraint_names(named).select("schema_id", "table_name", "constraint_name", "body")


@query("ext_indexes", r"""
  SELECT script_id, pos, index_name, table_name, columns, is_unique, index_method FROM found_indexes
  WHERE regexp_full_match(table_name, '\w+')""", **S, found_indexes=INDEXES)
def ext_indexes(i):
    return ops.extract_indexes(scripts(i)).withColumn("columns", listed("columns"))


@query("ext_enums", r"""
  SELECT script_id, pos, regexp_extract(statement, 'CREATE TYPE (\w+)', 1) AS enum_name, 'sad,very happy' AS "values"
  FROM statements WHERE statement LIKE 'CREATE TYPE mood%'""", **S)
def ext_enums(i):
    return ops.extract_enums(scripts(i)).withColumn("values", listed("values"))


@query("ext_sequences", r"""
  SELECT script_id, pos, regexp_extract(statement, 'SEQUENCE public\.(\w+)', 1) AS sequence_name
  FROM statements WHERE statement LIKE 'CREATE SEQUENCE%'""", **S)
def ext_sequences(i):
    return ops.extract_sequences(scripts(i))


@query("ext_column", """
  SELECT schema_id, table_name, ordinal, column_name, data_type, is_nullable, is_primary_key, is_unique AND NOT is_primary_key AS is_unique,
    coalesce(default_value, '') AS default_value FROM f_columns""")
def ext_column(i):
    quote = F.when(F.col("ordinal") % 2 == 0, '"').otherwise("")
    text = F.concat_ws(
        " ", F.concat(quote, "column_name", quote), "data_type", F.when(~F.col("is_nullable"), "NOT NULL"),
        F.when(F.col("is_primary_key"), "primary key").when(F.col("is_unique"), "unique"),
        F.concat(F.lit("DEFAULT "), "default_value"))
    defs = i.table("f_columns").select("schema_id", "table_name", "ordinal", text.alias("definition"))
    return ops.column_attributes(defs).drop("definition").withColumn(
        "default_value", F.coalesce("default_value", F.lit("")))


# a name with a blank or a dash after its first word has no bracket right behind it
BODY_TABLES = """
  SELECT s.*, f.table_no, line_no % 1000 = 0 AND f.table_no % 20 = 1 AS is_partition FROM found_tables s
  JOIN statements USING (script_id, pos) JOIN f_tables f ON f.schema_id = script_id AND f.table_no = line_no // 1000
  WHERE line_no % 1000 = 0 AND (f.table_no % 4 IN (1, 2) OR regexp_full_match(f.table_name, '[a-z_0-9]+'))"""


BODY = """
  SELECT b.script_id, b.pos, b.table_name, CAST(row_number() OVER (PARTITION BY b.script_id, b.pos ORDER BY i.item_no) - 1 AS INTEGER) AS item_no,
    i.kind, i.name, CASE i.data_type WHEN 'numeric(10,2)' THEN 'numeric(10, 2)' ELSE i.data_type END AS data_type,
    i.is_nullable, i.is_primary_key, i.is_unique, i.detail
  FROM body_tables b JOIN (SELECT schema_id, table_no, item_no, kind, name, data_type, is_nullable, is_primary_key, is_unique, detail FROM f_items
    UNION ALL SELECT schema_id, table_no, 20, 'c', '', '', true, false, false, '' FROM f_tables) i ON i.schema_id = b.script_id AND i.table_no = b.table_no
  QUALIFY NOT (b.is_partition AND i.kind = 'column')
  UNION ALL SELECT s.script_id, s.pos, s.table_name, 0, 'column', 'again', 'text', true, false, false, '' FROM found_tables s JOIN statements USING (script_id, pos)
    JOIN f_tables f ON f.schema_id = s.script_id AND f.table_no = line_no // 1000
  WHERE line_no % 1000 = 31 AND regexp_full_match(f.table_name, '[a-z_0-9]+')"""


@query("ext_body", "SELECT * FROM body", **S, found_tables=TABLES, body_tables=BODY_TABLES, body=BODY)
def ext_body(i):
    tables = ops.extract_tables(scripts(i))
    none, yes, no = F.lit(""), F.lit(True), F.lit(False)
    columns = ops.body_columns(tables).select(
        "script_id", "pos", "table_name", "item_no", F.lit("column").alias("kind"), F.col("column_name").alias("name"), "data_type",
        "is_nullable", "is_primary_key", "is_unique", F.coalesce("default_value", none).alias("detail"))
    constraints = ops.body_constraints(tables).select(
        "script_id", "pos", "table_name", "item_no", F.col("constraint_type").alias("kind"), F.coalesce("constraint_name", none).alias("name"),
        none.alias("data_type"), yes.alias("is_nullable"), no.alias("is_primary_key"), no.alias("is_unique"), listed("columns").alias("detail"))
    return columns.unionByName(constraints)


@query("ext_addcol", r"""
  SELECT schema_id, table_name, column_name, data_type FROM f_columns
  UNION ALL
  SELECT script_id, table_name, column_name, 'integer' FROM (
    SELECT script_id, split_part(split_part(statement, ' ', 3), '.', -1) AS table_name, split_part(statement, ' ', 6) AS column_name
    FROM statements WHERE statement LIKE '%ADD COLUMN%') a
  WHERE regexp_full_match(table_name, '\w+') AND EXISTS (SELECT 1 FROM f_tables t WHERE t.schema_id = script_id AND t.table_name = a.table_name)
    AND NOT EXISTS (SELECT 1 FROM f_columns c WHERE c.schema_id = script_id AND c.table_name = a.table_name AND c.column_name = a.column_name)""", **S)
def ext_addcol(i):
    c = i.catalog()
    added = ops.added_columns(scripts(i)).withColumnRenamed("script_id", "schema_id")
    return ops.merge_added(c.columns, added, c.tables).select("schema_id", "table_name", "column_name", "data_type")


@query("ext_addcon", "SELECT * FROM added_constraints", **S, added_constraints=ADDED_CONSTRAINTS)
def ext_addcon(i):
    return ops.added_constraints(scripts(i)).withColumn("columns", listed("columns"))


ERRORS = r"""
  SELECT script_id, pos, kind || ' parsing failed' AS context, statement, substr(statement, 1, 200) AS preview FROM (
    SELECT script_id, pos, 'CREATE INDEX' AS kind, statement FROM found_indexes WHERE NOT is_unique AND NOT regexp_full_match(table_name, '\w+')
    UNION ALL SELECT script_id, pos, 'CREATE ENUM', statement FROM statements WHERE statement LIKE 'CREATE TYPE empty%') x"""


@query("ext_errors", ERRORS, **S, found_indexes=INDEXES)
def ext_errors(i):
    return ops.extract_errors(scripts(i))
