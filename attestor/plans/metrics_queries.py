"""Queries: quality metrics, one row per schema."""

from pyspark.sql import functions as F

from attestor import fixed
from attestor.functions import quality
from attestor.operators import features, metrics as ops
from attestor.operators import types as type_ops
from attestor.plans import sql_parts as sql
from attestor.plans.reconcile_queries import silent
from attestor.plans.registry import query
from attestor.plans.types_queries import mapped_columns

KINDS = ["tables", "columns", "relationships", "constraints"]


def rounded(df):
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def dropped_features(i):
    return features.route_features(features.detect_features(i.views())).filter("action = 'DROPPED'")


def failed_casts(i):
    """Integer columns whose default cannot be read as an integer."""
    return i.views().columns.filter("data_type = 'integer' AND default_value IS NOT NULL").filter(
        type_ops.cast_value("default_value", "integer").isNull())


def all_warnings(i):
    """The catalog's warnings and those of the type mapping."""
    found = type_ops.type_warnings(mapped_columns(i)).select("schema_id", "source", "message")
    return i.views().warnings.unionByName(found)


def change_log(i):
    return type_ops.type_log(mapped_columns(i))


def _count(name, source, where="true"):
    return f"LEFT JOIN (SELECT schema_id, count(*) AS {name} FROM {source} WHERE {where} GROUP BY 1) USING (schema_id)"


_COUNTS = "\n".join(
    [_count(f"{k}_before", f"f_{k}") for k in KINDS] + [_count(f"{k}_after", f"c_{k}") for k in KINDS]
    + [_count("silent_n", "silent"), _count("silent_c", "silent", "severity = 'CRITICAL'"),
       _count("silent_h", "silent", "severity = 'HIGH'"), _count("silent_m", "silent", "severity = 'MEDIUM'"),
       _count("errors", "f_tables", "original_statement LIKE '%INHERITS%'"),
       _count("casts", "f_columns", "data_type = 'integer' AND default_value IS NOT NULL AND try_cast(default_value AS INTEGER) IS NULL"),
       _count("plain_warnings", "f_warnings"), _count("typed_warnings", "type_warnings"),
       _count("changes", "type_log"), _count("unexpected", "unexpected_changes"), _count("dropped", "dropped_features"),
       _count("checks", "f_constraints", "constraint_type = 'c'"),
       _count("lossy", "f_columns", f"regexp_matches(data_type, '{'|'.join(fixed.EXPECTED_LOSS_WORDS)}')")])
_NAMES = ([f"{k}_{w}" for k in KINDS for w in ["before", "after"]]
          + ["silent_n", "silent_c", "silent_h", "silent_m", "errors", "casts", "plain_warnings",
             "typed_warnings", "changes", "unexpected", "dropped", "checks", "lossy"])

_BANDS = " ".join(
    f"WHEN y >= {low} THEN {at}" + (f" + (y - {low}) / ({upper} - {low})" if upper else "")
    for (at, low), upper in zip(fixed.SIGMA_BANDS, [None] + [b[1] for b in fixed.SIGMA_BANDS]))


def sigma_sql(value: str) -> str:
    return f"(SELECT CASE WHEN d <= 0 THEN 6.0 WHEN d >= 1000000 THEN 0.0 {_BANDS} ELSE y END FROM (SELECT CAST({value} AS DOUBLE) AS d, 1 - CAST({value} AS DOUBLE) / 1000000 AS y))"


NAMED = dict(
    mapped=sql.MAPPED, type_warnings=sql.TYPE_WARNINGS, type_log=sql.TYPE_LOG,
    losses=sql.LOSSES, silent=sql.SILENT, features=sql.FEATURES, routed_features=sql.ROUTED_FEATURES,
    dropped_features="SELECT * FROM routed_features WHERE action = 'DROPPED'",
    unexpected_changes=f"""
  SELECT * FROM type_log WHERE lower(original_type) <> lower(new_type) AND NOT EXISTS (
    SELECT 1 FROM {sql.values(fixed.STANDARD_CHANGES, 'a, b')} WHERE contains(lower(original_type), a) AND contains(lower(new_type), b))""",
    counts="SELECT schema_id, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in _NAMES)
           + " FROM (SELECT DISTINCT schema_id FROM f_tables) s " + _COUNTS,
    rated="SELECT *, " + ", ".join(f"{k}_after / greatest({k}_before, 1) AS {k}_rate" for k in KINDS)
          + ", tables_before + columns_before + relationships_before + constraints_before AS opportunities FROM counts",
    counted="""
  SELECT *, silent_c + errors AS critical,
    silent_h + least(greatest(checks + lossy - plain_warnings, 0), 2) AS high, silent_m + casts AS medium,
    silent_h + least(greatest(checks + lossy - plain_warnings - typed_warnings, 0), 2) AS high_all FROM rated""",
    scored="""
  SELECT *, greatest(0, 1 - errors * 0.1::DOUBLE) AS syntax_score,
    CASE WHEN changes = 0 THEN least(1, (plain_warnings + typed_warnings) / greatest(unexpected + dropped, 1))
      WHEN unexpected + dropped = 0 THEN 1
      ELSE greatest(0.8, least(1, (plain_warnings + typed_warnings) / greatest(unexpected + dropped, 1))) END AS warning_completeness,
    greatest(0, 1 - silent_n * 0.05::DOUBLE) AS silent_score,
    least(1, tables_rate) AS tables_preservation, least(1, relationships_rate) AS relationships_preservation,
    least(1, constraints_rate) AS constraints_preservation,
    (least(1, tables_rate) * 3 + least(1, relationships_rate) * 5 + least(1, constraints_rate) * 4) / 12 AS semantic_preservation,
    critical * 3 + high_all * 2 + medium AS defects FROM counted""",
    finished=f"""
  SELECT *, least(1000000, defects / opportunities * 1000000) AS dpmo,
    {sigma_sql('least(1000000, defects / opportunities * 1000000)')} AS sigma_level,
    syntax_score * 0.5 + warning_completeness * 0.3 + silent_score * 0.2 AS compatibility FROM scored""",
    graded="""
  SELECT *, CASE WHEN sigma_level >= 6 AND compatibility >= 0.95 THEN 'EXCELLENT' WHEN sigma_level >= 5 AND compatibility >= 0.9 THEN 'GOOD'
      WHEN sigma_level >= 4 AND compatibility >= 0.8 THEN 'ACCEPTABLE' WHEN sigma_level >= 3 AND compatibility >= 0.7 THEN 'POOR'
      ELSE 'UNACCEPTABLE' END AS grade,
    tables_rate >= 1 AND columns_rate >= 1 AND silent_n = 0 AND compatibility >= 0.8 AS passed FROM finished""")


def metrics(i):
    return ops.quality_metrics(i.views(), i.views(copy=True), silent(i), all_warnings(i), change_log(i),
                               dropped_features(i), i.views().errors, failed_casts(i))


@query("met_stats", "SELECT schema_id, " + ", ".join(
    f"{k}_before, {k}_after, round({k}_rate, 6) AS {k}_rate" for k in KINDS) + " FROM rated", **NAMED)
def met_stats(i):
    return rounded(ops.conversion_statistics(i.views(), i.views(copy=True)))


@query("met_defects", """
  SELECT schema_id, critical, high, medium, critical * 3 + high * 2 + medium AS defects FROM counted""", **NAMED)
def met_defects(i):
    return ops.defects(silent(i), i.views().errors, i.views().warnings, failed_casts(i), i.views())


@query("met_opportunities", "SELECT schema_id, opportunities FROM rated", **NAMED)
def met_opportunities(i):
    return ops.opportunities(i.views())


@query("met_dpmo", """
  SELECT schema_id, round(least(1000000, (critical * 3 + high * 2 + medium) / opportunities * 1000000), 6) AS dpmo
  FROM counted""", **NAMED)
def met_dpmo(i):
    joined = met_defects(i).join(met_opportunities(i), "schema_id")
    return rounded(joined.select("schema_id", quality.dpmo(F.col("defects"), F.col("opportunities")).alias("dpmo")))


@query("met_sigma", f"""
  SELECT l_suppkey, n_lines, n_returned, round(dpmo, 6) AS dpmo, round({sigma_sql('dpmo')}, 6) AS sigma_level
  FROM (SELECT l_suppkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.09) AS n_returned,
    count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.09) / count(*) * 1000000 AS dpmo FROM lineitem GROUP BY 1) x""")
def met_sigma(i):
    # the level of any share of defects: here returned lines of each supplier
    lines = i.table("lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n_lines"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09)).alias("n_returned"))
    found = lines.withColumn("dpmo", quality.dpmo(F.col("n_returned"), F.col("n_lines")))
    return rounded(found.withColumn("sigma_level", quality.sigma(F.col("dpmo"))))


@query("met_preserve", """
  SELECT schema_id, round(tables_preservation, 6) AS tables_preservation, round(relationships_preservation, 6) AS relationships_preservation,
    round(constraints_preservation, 6) AS constraints_preservation, round(semantic_preservation, 6) AS semantic_preservation
  FROM scored""", **NAMED)
def met_preserve(i):
    return rounded(ops.preservation(ops.conversion_statistics(i.views(), i.views(copy=True))))


@query("met_expected", "SELECT schema_id, checks + lossy AS expected FROM counts", **NAMED)
def met_expected(i):
    return ops.expected_warnings(i.views())


@query("met_expected2", """
  SELECT schema_id, unexpected + dropped AS expected FROM counts WHERE changes + dropped > 0""", **NAMED)
def met_expected2(i):
    return ops.expected_from_log(change_log(i), dropped_features(i))


@query("met_compat", """
  SELECT schema_id, round(syntax_score, 6) AS syntax_score, round(warning_completeness, 6) AS warning_completeness,
    round(silent_score, 6) AS silent_score, round(compatibility, 6) AS compatibility FROM finished""", **NAMED)
def met_compat(i):
    return rounded(ops.compatibility(i.views(), i.views().errors, all_warnings(i), change_log(i),
                                     dropped_features(i), silent(i)))


@query("met_prevention", """
  SELECT schema_id, round(1 - silent_n / greatest(1, opportunities), 6) AS prevention FROM rated""", **NAMED)
def met_prevention(i):
    return rounded(ops.prevention(silent(i), i.views()))


@query("met_grade", "SELECT schema_id, grade FROM graded", **NAMED)
def met_grade(i):
    return metrics(i).select("schema_id", "grade")


@query("met_gate", "SELECT schema_id, passed FROM graded", **NAMED)
def met_gate(i):
    return ops.gate(metrics(i))


_ALL = ["sigma_level", "dpmo", "semantic_preservation", "compatibility", "syntax_score", "warning_completeness"]


@query("met_all", "SELECT schema_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _ALL) + """,
    critical, high_all AS high, medium, defects, opportunities, silent_n AS failures,
    round(1 - silent_n / greatest(1, opportunities), 6) AS prevention, plain_warnings + typed_warnings AS total_warnings,
    dropped AS features_dropped, changes AS types_converted, errors AS syntax_errors, grade, passed FROM graded""", **NAMED)
def met_all(i):
    return rounded(metrics(i).select(
        "schema_id", *_ALL, "critical", "high", "medium", "defects", "opportunities", "failures", "prevention",
        "total_warnings", "features_dropped", "types_converted", "syntax_errors", "grade", "passed"))
