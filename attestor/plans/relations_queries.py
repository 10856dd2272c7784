"""Queries: relationships and compatibility rules."""

from pyspark.sql import functions as F

from attestor.functions.names import listed
from attestor.operators import compatibility as cmp
from attestor.operators import relations as ops
from attestor.operators.catalog import primary_keys
from attestor.plans import sql_parts as sql
from attestor.plans.metrics_queries import rounded
from attestor.plans.registry import query

NAMED = dict(validated=sql.VALIDATED, unique_keys=sql.UNIQUE_KEYS, typed=sql.TYPED, built=sql.BUILT)
KEYED = dict(key_columns=sql.KEY_COLUMNS, issues=sql.ISSUES, scores=sql.SCORES)


def built_and_skipped(i):
    c = i.catalog()
    return ops.build_relationships(c.relationships, c.tables, c.columns, c.constraints)


def flat(df, *more):
    return df.select("schema_id", "rel_no", "source_table", listed("source_columns").alias("source_columns"),
                     "target_table", listed("target_columns").alias("target_columns"), *more)


_FLAT = "SELECT schema_id, rel_no, source_table, source_columns, target_table, target_columns"


@query("rel_validate", f"{_FLAT}, coalesce(skip_type, '') AS skip_type FROM validated", validated=sql.VALIDATED)
def rel_validate(i):
    c = i.catalog()
    return flat(ops.validate_relationships(c.relationships, c.tables, c.columns),
                F.coalesce("skip_type", F.lit("")).alias("skip_type"))


@query("rel_type", f"{_FLAT}, relationship_type, target_is_unique FROM typed", **NAMED)
def rel_type(i):
    c = i.catalog()
    valid = ops.validate_relationships(c.relationships, c.tables, c.columns).filter("skip_type IS NULL")
    return flat(ops.relationship_type(valid, ops.unique_keys(c.columns, c.constraints)),
                "relationship_type", "target_is_unique")


@query("rel_dedupe", """
  SELECT schema_id, min(rel_no) AS rel_no, source_table, source_columns, target_table, target_columns, count(*) - 1 AS n_removed
  FROM f_relationships GROUP BY schema_id, source_table, source_columns, target_table, target_columns""")
def rel_dedupe(i):
    return flat(ops.dedupe_relationships(i.catalog().relationships), "n_removed")


@query("rel_warn", """
  SELECT schema_id, message, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT schema_id, 'Composite relationship ' || source_table || ' -> ' || target_table || ' may cause parser issues' AS message,
      n_removed + 1 AS n FROM built WHERE source_columns LIKE '%,%'
    UNION ALL SELECT schema_id, 'Self-referencing relationship on ' || source_table, n_removed + 1 FROM built WHERE source_table = target_table
    UNION ALL SELECT schema_id, 'Relationship ' || source_table || ' -> ' || target_table || ' references non-unique columns', n_removed + 1
      FROM built WHERE NOT target_is_unique
    UNION ALL SELECT schema_id, 'Duplicate relationship ' || source_table || ' -> ' || target_table || ' removed', n_removed FROM built WHERE n_removed > 0
    UNION ALL SELECT schema_id, 'Skipped relationship ' || source_table || ' -> ' || target_table || ': ' || skip_type, 1
      FROM validated WHERE skip_type IS NOT NULL) x GROUP BY 1, 2""", **NAMED)
def rel_warn(i):
    return ops.relationship_warnings(*built_and_skipped(i))


@query("rel_report", """
  SELECT schema_id, coalesce(n_built, 0) AS n_built, coalesce(n_one, 0) AS n_one_to_one, coalesce(n_many, 0) AS n_many_to_one,
    coalesce(n_composite, 0) AS n_composite, coalesce(n_self, 0) AS n_self, coalesce(n_cascade, 0) AS n_cascade,
    CAST(coalesce(n_duplicates, 0) AS BIGINT) AS n_duplicates, coalesce(n_skipped, 0) AS n_skipped, """ + ", ".join(
    f"coalesce({s}, 0) AS n_{s.lower()}" for s in ops.SKIPS) + """
  FROM (SELECT schema_id, count(*) AS n_built, count(*) FILTER (relationship_type = 'one-to-one') AS n_one,
      count(*) FILTER (relationship_type = 'many-to-one') AS n_many, count(*) FILTER (source_columns LIKE '%,%') AS n_composite,
      count(*) FILTER (source_table = target_table) AS n_self, count(*) FILTER (on_delete = 'CASCADE' OR on_update = 'CASCADE') AS n_cascade,
      sum(n_removed) AS n_duplicates FROM built GROUP BY 1) b
  FULL JOIN (SELECT schema_id, count(*) AS n_skipped, """ + ", ".join(
    f"count(*) FILTER (skip_type = '{s}') AS {s}" for s in ops.SKIPS) + """
    FROM validated WHERE skip_type IS NOT NULL GROUP BY 1) k USING (schema_id)""", **NAMED)
def rel_report(i):
    return ops.relationship_report(*built_and_skipped(i))


@query("rel_action", """
  SELECT schema_id, rel_no, CASE WHEN on_delete IS NULL AND on_update IS NULL THEN 'none' WHEN on_delete = 'CASCADE' THEN 'cascade'
    WHEN on_delete = 'RESTRICT' THEN 'restrict' WHEN on_delete IN ('SET NULL', 'SET DEFAULT') THEN 'set' ELSE 'other' END AS action_class
  FROM f_relationships""")
def rel_action(i):
    return i.views().relationships.select(
        "schema_id", "rel_no", ops.action_class(F.col("on_delete"), F.col("on_update")).alias("action_class"))


@query("cmp_names", "SELECT * FROM issues WHERE issue_type IN ('INVALID_TABLE_NAME', 'INVALID_COLUMN_NAME', 'RESERVED_KEYWORD', 'LONG_COLUMN_NAME')", **KEYED)
def cmp_names(i):
    return cmp.name_issues(i.views().tables, i.views().columns)


@query("cmp_nopk", "SELECT * FROM issues WHERE issue_type = 'NO_PRIMARY_KEY'", **KEYED)
def cmp_nopk(i):
    c = i.catalog()
    return cmp.no_key_issues(c.tables, primary_keys(c.columns, c.constraints))


@query("cmp_types", "SELECT * FROM issues WHERE issue_type = 'COMPLEX_DATA_TYPE'", **KEYED)
def cmp_types(i):
    return cmp.complex_type_issues(i.views().columns)


@query("cmp_rels", "SELECT * FROM issues WHERE issue_type IN ('COMPOSITE_RELATIONSHIP', 'SELF_REFERENCING', 'CASCADE_ACTION_INVISIBLE')", **KEYED)
def cmp_rels(i):
    return cmp.relationship_issues(i.views().relationships)


@query("cmp_score", "SELECT schema_id, n_issues, n_high, round(score, 6) AS score FROM scores", **KEYED)
def cmp_score(i):
    return rounded(cmp.issue_score(cmp.all_issues(i.views()), i.views().tables))


@query("cmp_advice", f"""
  SELECT DISTINCT schema_id, v.advice FROM issues JOIN {sql.values(sql.fixed.COMPATIBILITY_ADVICE.items(), 'kind, advice')} ON kind = issue_type
  UNION ALL SELECT DISTINCT schema_id, '{sql.fixed.NO_ADVICE}' FROM f_tables WHERE schema_id NOT IN (
    SELECT schema_id FROM issues WHERE issue_type IN {sql.one_of(sql.fixed.COMPATIBILITY_ADVICE)})""", **KEYED)
def cmp_advice(i):
    return cmp.recommendations(cmp.all_issues(i.views()), i.views().tables)


@query("cmp_grade", """
  SELECT schema_id, n_high, CASE WHEN score >= 0.95 THEN 'EXCELLENT' WHEN score >= 0.85 THEN 'GOOD'
    WHEN score >= 0.7 THEN 'ACCEPTABLE' ELSE 'POOR' END AS grade FROM scores""", **KEYED)
def cmp_grade(i):
    return cmp.score_grade(cmp.issue_score(cmp.all_issues(i.views()), i.views().tables))


@query("cmp_limits", """
  SELECT schema_id, 'column name' AS kind, column_name AS subject, CAST(length(column_name) AS INTEGER) AS size
  FROM (SELECT schema_id, column_name || '_of_' || table_name AS column_name FROM f_columns) x WHERE length(column_name) > 63
  UNION ALL SELECT schema_id, 'relationship columns', source_table || ' -> ' || target_table,
    CAST(12 AS INTEGER) FROM f_relationships WHERE source_columns LIKE '%,%'""")
def cmp_limits(i):
    # the derived names stay below the limits, so names are made longer and keys wider here
    c = i.catalog()
    c.columns = c.columns.withColumn("column_name", F.concat("column_name", F.lit("_of_"), "table_name"))
    c.relationships = c.relationships.withColumn(
        "source_columns", F.flatten(F.array_repeat(F.col("source_columns"), 6)))
    return cmp.limit_issues(c)
