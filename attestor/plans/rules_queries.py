"""Queries: declared rules checked on rows."""

from pyspark.sql import functions as F

from attestor.operators import rules as ops
from attestor.plans.metrics_queries import rounded
from attestor.plans.registry import query


@query("val_notnull", """
  SELECT 'o_orderstatus' AS column_name, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_nulls FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (o_orderpriority = '5-LOW') FROM orders
  UNION ALL SELECT 'o_custkey', count(*), 0 FROM orders""")
def val_notnull(i):
    orders = i.table("orders").withColumns({
        "o_orderstatus": F.nullif("o_orderstatus", F.lit("F")),
        "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW"))})
    return ops.null_counts(orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("val_key", """
  SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(*) - 1 AS n_surplus FROM lineitem
  GROUP BY 1, 2 HAVING count(*) > 1""")
def val_key(i):
    return ops.duplicate_keys(i.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("val_fk", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
  WHERE l_linenumber <> 7 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def val_fk(i):
    lines = i.table("lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("l_orderkey"),
        "l_linenumber", "l_partkey", "l_suppkey")
    return ops.orphans(lines, i.table("orders").filter("o_orderstatus <> 'F'"), {"l_orderkey": "o_orderkey"})


@query("val_check", """
  SELECT 'quantity' AS rule, count(*) AS n_rows, count(*) FILTER (NOT l_quantity <= 45) AS n_violations FROM lineitem
  UNION ALL SELECT 'discount', count(*), count(*) FILTER (l_returnflag <> 'A' AND NOT l_discount < 0.08) FROM lineitem
  UNION ALL SELECT 'ship date', count(*), count(*) FILTER (l_shipdate < TIMESTAMP '1995-01-01') FROM lineitem""")
def val_check(i):
    return ops.check_rules(i.table("lineitem"), {
        "quantity": F.col("l_quantity") <= 45,
        # null where the flag is A, and null is met
        "discount": F.when(F.col("l_returnflag") != "A", F.col("l_discount") < 0.08),
        "ship date": F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")})


@query("val_enum", """
  SELECT event_type AS value, count(*) AS n_rows FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1""")
def val_enum(i):
    return ops.domain_violations(i.table("events"), "event_type", ["view", "click"])


@query("val_overlap", """
  SELECT event_id, user_id, latest_end > ts AS overlaps FROM (
    SELECT *, max(ts + to_hours(event_id % 5)) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_end FROM events) x WHERE latest_end > ts""")
def val_overlap(i):
    events = i.table("events").withColumn(
        "until", F.expr("ts + make_dt_interval(0, CAST(event_id % 5 AS INT), 0, 0)"))
    return ops.overlaps(events, "user_id", "ts", "until", "event_id").select(
        "event_id", "user_id", (F.col("latest_end") > F.col("ts")).alias("overlaps"))


@query("val_default", """
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderpriority = '5-LOW' THEN '3-MEDIUM' ELSE o_orderpriority END AS o_orderpriority,
    CAST(o_orderstatus = 'F' AS INTEGER) + CAST(o_orderpriority = '5-LOW' AS INTEGER) AS n_filled FROM orders""")
def val_default(i):
    orders = i.table("orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return ops.fill_defaults(orders, {"o_orderstatus": "O", "o_orderpriority": "3-MEDIUM"})


@query("val_cascade", """
  SELECT 1 AS level, 'orders' AS table_name, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3
  UNION ALL SELECT 2, 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3""")
def val_cascade(i):
    seed = i.table("customer").filter("c_nationkey = 3").select("c_custkey")
    return ops.cascade_reach(seed, [
        ("orders", i.table("orders"), "o_custkey", "o_orderkey"),
        ("lineitem", i.table("lineitem"), "l_orderkey", "l_linenumber")])


# orders refer to each other as in a heap with four branches; some refer back, which makes circles
_REFERENCES = """
  SELECT o_orderkey AS child, o_orderkey // 4 AS parent FROM orders
  UNION ALL SELECT o_orderkey // 4, o_orderkey FROM orders WHERE o_orderkey % 100 = 7"""


@query("val_closure", """
  WITH RECURSIVE refs AS (""" + _REFERENCES + """),
  reached AS (SELECT o_orderkey AS key, 0 AS level FROM orders WHERE o_orderkey IN (5, 30, 77)
    UNION SELECT child, level + 1 FROM reached JOIN refs ON parent = key WHERE level < 40)
  SELECT key, min(level) AS level FROM reached GROUP BY 1""")
def val_closure(i):
    orders = i.table("orders")
    up = F.floor(F.col("o_orderkey") / 4)
    references = orders.select(up.alias("parent"), F.col("o_orderkey").alias("child")).unionByName(
        orders.filter("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("parent"), up.alias("child")))
    return ops.cascade_closure(orders.filter("o_orderkey IN (5, 30, 77)").select("o_orderkey"), references)


@query("val_cardinality", """
  SELECT max(n) AS most_children, count(*) AS n_parents, count(*) FILTER (n > 0) AS n_used,
    round(count(*) FILTER (n > 0) / count(*), 6) AS used_share,
    CASE WHEN max(n) > 1 THEN 'many-to-one' ELSE 'one-to-one' END AS cardinality
  FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) x""")
def val_cardinality(i):
    return rounded(ops.measured_cardinality(i.table("orders"), i.table("customer"), ("o_custkey", "c_custkey")))
