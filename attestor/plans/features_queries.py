"""Queries: feature detection and decisions."""

from pyspark.sql import functions as F

from attestor.operators import features as ops
from attestor.operators.catalog import organize_columns, organize_relationships
from attestor.plans import sql_parts as sql
from attestor.plans.registry import query


def all_features(i):
    return ops.detect_features(i.views())


@query("fea_column", sql.COLUMN_FEATURES)
def fea_column(i):
    return ops.column_features(organize_columns(i.views().columns))


@query("fea_types", sql.TYPE_FEATURES)
def fea_types(i):
    return ops.type_features(organize_columns(i.views().columns))


@query("fea_table", sql.TABLE_FEATURES)
def fea_table(i):
    return ops.table_features(i.views().tables)


@query("fea_constraint", sql.CONSTRAINT_FEATURES)
def fea_constraint(i):
    return ops.constraint_features(i.views().constraints)


@query("fea_index", sql.INDEX_FEATURES)
def fea_index(i):
    return ops.index_features(i.views().indexes)


@query("fea_rel", sql.RELATIONSHIP_FEATURES)
def fea_rel(i):
    return ops.relationship_features(organize_relationships(i.views().relationships))


@query("fea_all", "SELECT *, severity IN ('HIGH', 'CRITICAL') AS is_issue FROM features", features=sql.FEATURES)
def fea_all(i):
    return all_features(i)


@query("fea_summary", """
  SELECT schema_id, coalesce(severity, 'ALL') AS severity, coalesce(feature_type, 'ALL') AS feature_type,
    count(*) AS n_features FROM features
  GROUP BY GROUPING SETS ((schema_id, severity), (schema_id, feature_type), (schema_id))""", features=sql.FEATURES)
def fea_summary(i):
    return ops.feature_summary(all_features(i))


@query("fea_critical", "SELECT * FROM features WHERE severity = 'CRITICAL'", features=sql.FEATURES)
def fea_critical(i):
    return ops.critical(all_features(i)).drop("is_issue")


@query("fea_route", "SELECT schema_id, feature_type, location, action FROM routed_features",
       features=sql.FEATURES, routed_features=sql.ROUTED_FEATURES)
def fea_route(i):
    return ops.route_features(all_features(i)).select("schema_id", "feature_type", "location", "action")


@query("fea_notes", """
  SELECT schema_id, feature_type, location, 'note' AS entry, note AS text FROM noted
  UNION ALL SELECT schema_id, feature_type, location, 'warning', 'CASCADE action at ' || location || ' is hidden in diagrams'
    FROM noted WHERE feature_type = 'CASCADE_ACTION'
  UNION ALL SELECT schema_id, feature_type, location, 'warning', 'Dropped ' || feature_type || ' at ' || location || ': ' || note
    FROM noted WHERE action = 'DROPPED'
  UNION ALL SELECT schema_id, feature_type, location, 'warning', 'Flatten or document the inheritance of ''' || location || ''''
    FROM noted WHERE feature_type = 'TABLE_INHERITANCE'
  UNION ALL SELECT schema_id, feature_type, location, 'warning', 'Represent the partitions of ''' || location || ''' as tables'
    FROM noted WHERE feature_type = 'TABLE_PARTITIONING'""",
       features=sql.FEATURES, routed_features=sql.ROUTED_FEATURES, noted="""
  SELECT *, CASE feature_type WHEN 'ARRAY_TYPE' THEN 'array type kept with quotes'
    WHEN 'CHECK_CONSTRAINT' THEN 'CHECK constraint dropped with a warning'
    WHEN 'CASCADE_ACTION' THEN 'CASCADE action at ' || location || ' kept but not visible'
    WHEN 'TABLE_INHERITANCE' THEN 'table inheritance of ''' || location || ''' lost'
    WHEN 'TABLE_PARTITIONING' THEN 'table partitioning of ''' || location || ''' lost'
    ELSE CASE WHEN feature_type IN ('GEOMETRIC_TYPE', 'NETWORK_TYPE', 'RANGE_TYPE')
        THEN feature_type || ' ''' || data_type || ''' at ' || location || ' converted to text'
      WHEN action = 'DROPPED' THEN feature_type || ' at ' || location || ' not supported'
      ELSE feature_type || ' at ' || location || ' handled with limitations' END END AS note
  FROM routed_features""")
def fea_notes(i):
    return ops.feature_notes(ops.route_features(all_features(i)))


@query("fea_report", """
  SELECT schema_id, action, feature_type, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
    count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium,
    count(*) FILTER (severity = 'LOW') AS n_low FROM routed_features GROUP BY ALL""",
       features=sql.FEATURES, routed_features=sql.ROUTED_FEATURES)
def fea_report(i):
    return ops.feature_report(ops.route_features(all_features(i)))


@query("fea_decision", """
  SELECT schema_id, decision, feature_type, location, rn, n_total, greatest(n_total - 5, 0) AS n_more FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY schema_id, decision ORDER BY location, feature_type) AS INTEGER) AS rn,
      count(*) OVER (PARTITION BY schema_id, decision) AS n_total FROM needed) x WHERE rn <= 5""",
       features=sql.FEATURES, needed=sql.NEEDED_DECISIONS)
def fea_decision(i):
    return ops.decision_groups(all_features(i)).select(
        "schema_id", "decision", "feature_type", "location", "rn", "n_total", "n_more")


@query("fea_policy", f"""
  SELECT s.schema_id, d.decision, CASE WHEN d.decision = 'ARRAY_TYPE' AND s.schema_id % 3 = 0 AND n.schema_id IS NOT NULL
    THEN 'text_fallback' ELSE d.choice END AS choice
  FROM (SELECT DISTINCT schema_id FROM f_tables) s
  CROSS JOIN (SELECT * FROM {sql.values(sql.fixed.DEFAULT_DECISIONS.items(), 'decision, choice')}) d
  LEFT JOIN (SELECT DISTINCT schema_id, decision FROM needed) n ON n.schema_id = s.schema_id AND n.decision = d.decision""",
       features=sql.FEATURES, needed=sql.NEEDED_DECISIONS)
def fea_policy(i):
    tables = i.views().tables
    # every third database asks for arrays as text
    overrides = (tables.filter("schema_id % 3 = 0").select(
        "schema_id", F.lit("ARRAY_TYPE").alias("decision"), F.lit("text_fallback").alias("choice")).distinct())
    return ops.decisions(tables, all_features(i), overrides)
