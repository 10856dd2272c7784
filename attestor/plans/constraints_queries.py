"""Queries: constraint declarations."""

from attestor.operators import constraints as ops
from attestor.plans import sql_parts as sql
from attestor.plans.registry import query


def routed(i):
    return ops.route_constraints(i.views().constraints)


@query("con_route", """
  SELECT schema_id, table_name, constraint_name, constraint_type, action, change FROM routed""", routed=sql.ROUTED)
def con_route(i):
    return routed(i).select("schema_id", "table_name", "constraint_name", "constraint_type", "action", "change")


@query("con_defer", """
  SELECT schema_id, table_name, constraint_name, change, definition, new_definition FROM routed
  WHERE action = 'MODIFIED'""", routed=sql.ROUTED)
def con_defer(i):
    return ops.modification_log(routed(i))


@query("con_drops", "SELECT * FROM drops", routed=sql.ROUTED, drops=sql.DROPS)
def con_drops(i):
    return ops.drop_log(routed(i))


@query("con_warn", "SELECT * FROM constraint_warnings", routed=sql.ROUTED, drops=sql.DROPS,
       constraint_warnings=sql.CONSTRAINT_WARNINGS)
def con_warn(i):
    return ops.constraint_warnings(routed(i)).drop("source")


@query("con_apply", """
  SELECT c.schema_id, c.table_name, c.ordinal, c.column_name, c.is_nullable AND NOT coalesce(pk, false) AS is_nullable,
    c.is_primary_key OR coalesce(pk, false) AS is_primary_key, c.is_unique OR pk IS NOT NULL AS is_unique
  FROM f_columns c LEFT JOIN (
    SELECT schema_id, table_name, columns, bool_or(constraint_type = 'p') AS pk FROM f_constraints
    WHERE constraint_type IN ('p', 'u') GROUP BY 1, 2, 3) k
  ON k.schema_id = c.schema_id AND k.table_name = c.table_name AND k.columns = c.column_name""")
def con_apply(i):
    c = i.catalog()
    return ops.apply_keys(c.columns, c.constraints).select(
        "schema_id", "table_name", "ordinal", "column_name", "is_nullable", "is_primary_key", "is_unique")


@query("con_report", """
  SELECT schema_id, coalesce(action, 'ALL') AS action, coalesce(change, 'ALL') AS change, count(*) AS n_constraints
  FROM routed GROUP BY GROUPING SETS ((schema_id, action, change), (schema_id, action), (schema_id))""",
       routed=sql.ROUTED)
def con_report(i):
    return ops.constraint_report(routed(i))
