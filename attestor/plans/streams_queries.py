"""Queries: streams over the events, run until the source is read."""

from pyspark.sql import functions as F

from attestor.functions.names import listed
from attestor.plans.metrics_queries import rounded, sigma_sql
from attestor.plans.registry import query
from attestor.streaming import stream as ops


def events(i):
    schema = i.table("events").schema
    read = i.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(i.dir)
    # a watermark needs a timestamp with a zone; the session zone is UTC
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_dpmo", f"""
  SELECT window_start, n_rows, n_defects, round(dpmo, 6) AS dpmo, round({sigma_sql('dpmo')}, 6) AS sigma_level FROM (
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_defects,
      count(*) FILTER (event_type = 'error') / count(*) * 1000000 AS dpmo FROM events GROUP BY 1) x""")
def str_dpmo(i):
    windows = ops.stream_quality(events(i), F.col("event_type") == "error")
    return rounded(ops.run_updates(windows, ["window_start"], "windows")).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@query("str_check", """
  SELECT event_id, user_id, concat_ws(',', CASE WHEN NOT value < 90 THEN 'value' END, CASE WHEN event_type = 'error' THEN 'type' END,
    CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) THEN 'reference' END) AS broken FROM events""")
def str_check(i):
    rules = {"value": F.col("value") < 90, "type": F.col("event_type") != "error"}
    checked = ops.stream_validate(events(i), rules, i.table("customer").filter("c_nationkey <> 3"), ("user_id", "c_custkey"))
    return ops.run_available(checked, "checked").select("event_id", "user_id", listed("broken").alias("broken"))


@query("str_first", "SELECT DISTINCT user_id, event_type FROM events")
def str_first(i):
    first = ops.stream_first(events(i), ["user_id", "event_type"])
    return ops.run_available(first.select("user_id", "event_type"), "first")
