"""Queries: reconciliation of a copy with its source."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor import fixed
from attestor.operators import reconcile as ops
from attestor.plans import sql_parts as sql
from attestor.plans.registry import query


def silent(i):
    return ops.silent_failures(i.catalog(), i.catalog(copy=True), i.views().warnings)


@query("rec_tables", sql.MISSING_TABLES)
def rec_tables(i):
    return ops.missing_tables(i.catalog().tables, i.catalog(copy=True).tables)


@query("rec_rels", "SELECT *, 'pair' AS compared FROM (" + sql.MISSING_RELATIONSHIPS + """)
  UNION ALL SELECT DISTINCT schema_id, 'MISSING_RELATIONSHIP', 'HIGH', source_table, target_table, CAST(1 AS BIGINT),
    'Relationship ' || source_table || ' -> ' || target_table || ' is not in the copy', '""" + fixed.LOSS_IMPACTS["MISSING_RELATIONSHIP"] + """', 'columns'
  FROM f_relationships a WHERE NOT EXISTS (SELECT 1 FROM c_relationships b WHERE b.schema_id = a.schema_id
    AND b.source_table = a.source_table AND b.target_table = a.target_table
    AND b.source_columns = a.source_columns AND b.target_columns = a.target_columns)""")
def rec_rels(i):
    a, b = i.catalog().relationships, i.catalog(copy=True).relationships
    return reduce(DataFrame.unionByName, [
        ops.missing_relationships(a, b, by).withColumn("compared", F.lit(by)) for by in ["pair", "columns"]])


@query("rec_constraints", sql.MISSING_CONSTRAINTS)
def rec_constraints(i):
    b = i.catalog(copy=True)
    return ops.missing_constraints(i.catalog().constraints, b.constraints, b.tables)


@query("rec_cascade", sql.HIDDEN_CASCADES)
def rec_cascade(i):
    return ops.hidden_cascades(i.views(copy=True).relationships)


@query("rec_columns", sql.MISSING_COLUMNS)
def rec_columns(i):
    b = i.catalog(copy=True)
    return ops.missing_columns(i.catalog().columns, b.columns, b.tables)


@query("rec_documented", """
  SELECT *, false AS is_documented FROM silent
  UNION ALL (SELECT *, true FROM losses EXCEPT ALL SELECT *, true FROM silent)""", losses=sql.LOSSES, silent=sql.SILENT)
def rec_documented(i):
    losses = ops.all_losses(i.catalog(), i.catalog(copy=True))
    return ops.mark_documented(losses, i.views().warnings)


@query("rec_all", "SELECT * FROM silent", losses=sql.LOSSES, silent=sql.SILENT)
def rec_all(i):
    return silent(i)


@query("rec_report", """
  SELECT schema_id, coalesce(type, 'ALL') AS type, coalesce(severity, 'ALL') AS severity, count(*) AS n_failures,
    count(*) FILTER (severity0 = 'CRITICAL') AS n_critical, count(*) FILTER (severity0 = 'HIGH') AS n_high,
    count(*) FILTER (severity0 = 'MEDIUM') AS n_medium
  FROM (SELECT *, severity AS severity0 FROM silent) x
  GROUP BY GROUPING SETS ((schema_id, type), (schema_id, severity), (schema_id))""",
       losses=sql.LOSSES, silent=sql.SILENT)
def rec_report(i):
    return ops.failure_report(silent(i))


@query("rec_rows", """
  SELECT o_orderkey, CASE WHEN o_orderkey < 0 THEN 'added' WHEN o_orderkey % 50 = 7 THEN 'lost' ELSE 'changed' END AS status,
    CAST(CASE WHEN o_orderkey < 0 THEN 0 ELSE 1 END AS BIGINT) AS n_before,
    CAST(CASE WHEN o_orderkey >= 0 AND o_orderkey % 50 = 7 THEN 0 ELSE 1 END AS BIGINT) AS n_after
  FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 7 OR o_orderkey % 41 = 3
      OR o_orderkey % 59 = 4
    UNION ALL SELECT -1 - o_orderkey FROM orders WHERE o_orderkey % 97 = 0) x""")
def rec_rows(i):
    # in one row of 59 a null changes places with a value
    swapped = F.when(F.col("o_orderkey") % 59 != 4, "v")
    a = i.table("orders").withColumns({"_left": F.lit("v"), "_right": swapped})
    price = F.when(F.col("o_orderkey") % 41 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    b = (a.filter("o_orderkey % 50 <> 7").withColumns({"o_totalprice": price, "_left": swapped, "_right": F.lit("v")})
         .unionByName(a.filter("o_orderkey % 97 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))))
    return ops.reconcile_rows(a, b, ["o_orderkey"])


@query("rec_ranges", """
  SELECT o_orderkey, CASE WHEN o_orderkey < 0 THEN 'added' WHEN o_orderkey % 5003 = 7 THEN 'lost' ELSE 'changed' END AS status,
    CAST(CASE WHEN o_orderkey < 0 THEN 0 ELSE 1 END AS BIGINT) AS n_before,
    CAST(CASE WHEN o_orderkey >= 0 AND o_orderkey % 5003 = 7 THEN 0 ELSE 1 END AS BIGINT) AS n_after
  FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5003 = 7 OR o_orderkey % 5009 = 3
    UNION ALL SELECT -1 - o_orderkey FROM orders WHERE o_orderkey % 5011 = 0) x""")
def rec_ranges(i):
    a = i.table("orders")
    price = F.when(F.col("o_orderkey") % 5009 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    b = (a.filter("o_orderkey % 5003 <> 7").withColumn("o_totalprice", price)
         .unionByName(a.filter("o_orderkey % 5011 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))))
    return ops.reconcile_ranges(a, b, ["o_orderkey"])


@query("rec_groups", """
  SELECT l_suppkey, l_returnflag, count(*) AS n_before, count(*) FILTER (l_partkey % 50 <> 7) AS n_after,
    count(*) FILTER (l_partkey % 50 = 7) AS n_lost FROM lineitem GROUP BY 1, 2
  HAVING count(*) FILTER (l_partkey % 50 = 7) > 0""")
def rec_groups(i):
    a = i.table("lineitem")
    return ops.reconcile_counts(a, a.filter("l_partkey % 50 <> 7"), ["l_suppkey", "l_returnflag"])
