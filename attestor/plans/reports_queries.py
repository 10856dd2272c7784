"""Queries: report tables and run log."""

from pyspark.sql import functions as F

from attestor import fixed
from attestor.functions.names import listed
from attestor.operators import compatibility, features, lines, report as ops, runlog
from attestor.operators import constraints as con
from attestor.operators import metrics as met
from attestor.plans import sql_parts as sql
from attestor.plans.lines_queries import LINT
from attestor.plans.metrics_queries import (KINDS, NAMED, all_warnings, change_log, dropped_features,
                                            metrics, rounded)
from attestor.plans.reconcile_queries import silent
from attestor.plans.registry import query

DROPPED = dict(routed=sql.ROUTED, drops=sql.DROPS)


def drops(i):
    return con.drop_log(con.route_constraints(i.views().constraints))


def first(source: str, keys: str, order: str, n: int, columns: str) -> str:
    return f"""SELECT {columns}, rn, n_total, greatest(n_total - {n}, 0) AS n_more FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS INTEGER) AS rn,
        count(*) OVER (PARTITION BY {keys}) AS n_total FROM {source}) x WHERE rn <= {n}"""


_FIRST = ["rn", "n_total", "n_more"]


@query("rep_warnings", """
  SELECT schema_id, source, count(*) AS n_warnings FROM (SELECT schema_id, source FROM f_warnings
    UNION ALL SELECT schema_id, 'type' FROM type_warnings UNION ALL SELECT schema_id, 'constraint' FROM constraint_warnings) x GROUP BY 1, 2""",
       mapped=sql.MAPPED, type_warnings=sql.TYPE_WARNINGS, **DROPPED, constraint_warnings=sql.CONSTRAINT_WARNINGS)
def rep_warnings(i):
    more = con.constraint_warnings(con.route_constraints(i.views().constraints))
    return ops.warning_categories(all_warnings(i).unionByName(more))


@query("rep_examples", first("type_log", "schema_id, reason", "table_name, column_name", 3,
                             "schema_id, reason, table_name, column_name, original_type, new_type"),
       mapped=sql.MAPPED, type_log=sql.TYPE_LOG)
def rep_examples(i):
    return ops.reason_examples(change_log(i))


@query("rep_types", """
  SELECT schema_id, original_type, count(*) AS n_columns, string_agg(DISTINCT new_type, ',' ORDER BY new_type) AS new_types
  FROM type_log GROUP BY 1, 2""", mapped=sql.MAPPED, type_log=sql.TYPE_LOG)
def rep_types(i):
    return ops.by_original_type(change_log(i)).withColumn("new_types", listed("new_types"))


@query("rep_arrays", first("(SELECT * FROM type_log WHERE original_type LIKE '%[]%')", "schema_id", "table_name, column_name", 10,
                           "schema_id, table_name, column_name, original_type, new_type"),
       mapped=sql.MAPPED, type_log=sql.TYPE_LOG)
def rep_arrays(i):
    return ops.array_examples(change_log(i)).drop("reason")


@query("rep_failures", first("silent", "schema_id, severity", "description, type", 5, "schema_id, severity, type, description")
       + " UNION ALL SELECT schema_id, 'ALL', type, '', 0, count(*), 0 FROM silent GROUP BY schema_id, type",
       losses=sql.LOSSES, silent=sql.SILENT)
def rep_failures(i):
    failures = silent(i)
    by_type = ops.failures_by_type(failures).select(
        "schema_id", F.lit("ALL").alias("severity"), "type", F.lit("").alias("description"), F.lit(0).alias("rn"),
        F.col("n_failures").alias("n_total"), F.lit(0).cast("long").alias("n_more"))
    return ops.failure_examples(failures).select(
        "schema_id", "severity", "type", "description", *_FIRST).unionByName(by_type)


@query("rep_drops", first("drops", "schema_id, kind", "table_name, constraint_name", 5,
                          "schema_id, kind, table_name, constraint_name, reason"), **DROPPED)
def rep_drops(i):
    return ops.drop_examples(drops(i)).select("schema_id", "kind", "table_name", "constraint_name", "reason", *_FIRST)


@query("rep_features", f"""SELECT f.*, v.impact FROM ({first("routed_features", "schema_id, action, feature_type", "location", 2,
       "schema_id, action, feature_type, location")}) f
  LEFT JOIN {sql.values(fixed.FEATURE_IMPACT.items(), 't, impact')} ON t = f.feature_type""",
       features=sql.FEATURES, routed_features=sql.ROUTED_FEATURES)
def rep_features(i):
    routed = features.route_features(features.detect_features(i.views()))
    return ops.feature_examples(routed).select("schema_id", "action", "feature_type", "location", "impact", *_FIRST)


_ADVICE = fixed.REPORT_ADVICE


@query("rep_advice", f"""
  SELECT schema_id, '{_ADVICE["low_sigma"]}' AS advice FROM finished WHERE sigma_level < 4
  UNION ALL SELECT schema_id, '{_ADVICE["dropped_features"]}' FROM finished WHERE dropped > 0
  UNION ALL SELECT DISTINCT schema_id, '{_ADVICE["array_types"]}' FROM type_log WHERE original_type LIKE '%[]%'
  UNION ALL SELECT DISTINCT schema_id, '{_ADVICE["dropped_checks"]}' FROM drops WHERE kind = 'CHECK'
  UNION ALL SELECT schema_id, '{fixed.NO_REPORT_ADVICE}' FROM finished WHERE sigma_level >= 4 AND dropped = 0
    AND schema_id NOT IN (SELECT schema_id FROM type_log WHERE original_type LIKE '%[]%')
    AND schema_id NOT IN (SELECT schema_id FROM drops WHERE kind = 'CHECK')""", **NAMED, **DROPPED)
def rep_advice(i):
    return ops.report_advice(metrics(i), change_log(i), drops(i))


@query("rep_summary", """
  SELECT schema_id, round(sigma_level, 6) AS sigma_level, grade, round(compatibility, 6) AS compatibility, silent_n AS failures,
    CASE WHEN compatibility > 0.9 THEN 'achieved' ELSE 'issues' END AS parser_status,
    CASE WHEN silent_n = 0 THEN 'none' ELSE 'documented' END AS silent_status,
    CASE WHEN sigma_level >= 6 THEN 'six sigma' WHEN sigma_level >= 4 THEN 'target met' ELSE 'issues' END AS quality_status
  FROM graded""", **NAMED)
def rep_summary(i):
    return rounded(ops.executive_summary(metrics(i)))


@query("rep_stats", " UNION ALL ".join(
    f"SELECT schema_id, '{k}' AS element, {k}_before AS n_before, {k}_after AS n_after, round({k}_rate, 6) AS rate FROM rated"
    for k in KINDS), **NAMED)
def rep_stats(i):
    return rounded(ops.statistics_long(met.conversion_statistics(i.views(), i.views(copy=True))))


@query("rep_totals", """
  SELECT schema_id, plain_warnings + typed_warnings AS n_warnings, changes AS n_transformations, dropped AS n_features_dropped,
    coalesce(d.n, 0) AS n_constraints_dropped, coalesce(r.n, 0) AS n_repairs, coalesce(s.n, 0) AS n_issues
  FROM counts LEFT JOIN (SELECT schema_id, count(*) AS n FROM drops GROUP BY 1) d USING (schema_id)
  LEFT JOIN (SELECT doc AS schema_id, count(*) AS n FROM lint WHERE severity = 'ERROR' GROUP BY 1) r USING (schema_id)
  LEFT JOIN (SELECT schema_id, count(*) AS n FROM issues GROUP BY 1) s USING (schema_id)
  WHERE plain_warnings + typed_warnings + changes + dropped + coalesce(d.n, 0) + coalesce(r.n, 0) + coalesce(s.n, 0) > 0""",
       **NAMED, **DROPPED, lint=LINT, key_columns=sql.KEY_COLUMNS, issues=sql.ISSUES)
def rep_totals(i):
    # each error of the line lint is a place to repair
    repairs = lines.lint_lines(i.table("f_diagram")).filter("severity = 'ERROR'").withColumnRenamed("doc", "schema_id")
    return ops.overview(all_warnings(i), change_log(i), dropped_features(i), drops(i), repairs,
                        compatibility.all_issues(i.views()))


# a run log from the events: the event type stands for the error class
_CLASS = """CASE event_type WHEN 'view' THEN 'ParsingError' WHEN 'click' THEN 'TransformationError' WHEN 'purchase' THEN 'GenerationError'
  WHEN 'error' THEN 'QualityError' ELSE 'Warning' END"""
_SEVERITY = "CASE event_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE NULL END"
RUN_LOG = f"""SELECT user_id AS run_id, event_id, {_CLASS} AS error_class, {_SEVERITY} AS severity,
  CASE WHEN event_id % 11 = 0 THEN false ELSE NULL END AS recoverable FROM events"""
ISSUES = """
  SELECT *, severity IN ('CRITICAL', 'HIGH') AS is_error FROM (
    SELECT run_id, event_id, error_class, recoverable0 IS NULL AND sev <> 'CRITICAL' AS recoverable, sev AS severity FROM (
      SELECT run_id, event_id, error_class, recoverable AS recoverable0, coalesce(severity, CASE error_class WHEN 'ParsingError' THEN 'HIGH'
        WHEN 'QualityError' THEN 'CRITICAL' ELSE 'MEDIUM' END) AS sev FROM run_log) x) y"""
LOGGED = dict(run_log=RUN_LOG, run_issues=ISSUES)


def routed_issues(i):
    log = i.table("events").select(
        F.col("user_id").alias("run_id"), "event_id", F.expr(_CLASS).alias("error_class"),
        F.expr(_SEVERITY).alias("severity"), F.when(F.col("event_id") % 11 == 0, F.lit(False)).alias("recoverable"))
    return runlog.route_issues(log)


@query("err_route", """
  SELECT run_id, event_id, error_class, severity, CASE WHEN is_error THEN 'error' ELSE 'warning' END AS level, recoverable
  FROM run_issues""", **LOGGED)
def err_route(i):
    return routed_issues(i)


@query("err_summary", """
  SELECT run_id, coalesce(severity, 'ALL') AS severity, coalesce(error_class, 'ALL') AS error_class,
    count(*) FILTER (is_error) AS n_errors, count(*) FILTER (NOT is_error) AS n_warnings,
    bool_or(severity0 = 'CRITICAL') AS has_critical, bool_or(is_error AND recoverable) AS has_recoverable
  FROM (SELECT *, severity AS severity0 FROM run_issues) x
  GROUP BY GROUPING SETS ((run_id, severity), (run_id, error_class), (run_id))""", **LOGGED)
def err_summary(i):
    return runlog.issue_summary(routed_issues(i))


@query("err_continue", """
  SELECT run_id, NOT bool_or(is_error AND (severity = 'CRITICAL' OR NOT recoverable)) AS should_continue
  FROM run_issues GROUP BY 1""", **LOGGED)
def err_continue(i):
    return runlog.should_continue(routed_issues(i))


_ENTRY = """CASE event_id % 6 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' WHEN 2 THEN 'silent_failure' WHEN 3 THEN 'type_transformation'
  WHEN 4 THEN 'constraint_drop' ELSE 'feature_drop' END"""


@query("err_counters", f"""
  SELECT run_id, count(*) FILTER (entry = 'warning') AS warnings, count(*) FILTER (entry IN ('error', 'silent_failure')) AS errors,
    count(*) FILTER (entry = 'type_transformation') AS transformations, count(*) FILTER (entry LIKE '%drop') AS dropped_items
  FROM (SELECT user_id AS run_id, {_ENTRY} AS entry FROM events) x GROUP BY 1""")
def err_counters(i):
    return runlog.run_counters(i.table("events").select(F.col("user_id").alias("run_id"), F.expr(_ENTRY).alias("entry")))
