"""Pieces of DuckDB SQL that several comparisons share."""

from attestor import fixed


def values(rows, names: str) -> str:
    """A constant table."""
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({names})"


def one_of(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def mapped(mapping=fixed.TYPE_MAP, source: str = "f_columns") -> str:
    """The type mapping as SQL."""
    return f"""
  SELECT c.*, CASE WHEN e.enum_name IS NOT NULL THEN 'enum' WHEN data_type LIKE '%[]%' THEN 'array'
      WHEN m.target IS NOT NULL THEN 'known' ELSE 'fallback' END AS type_rule,
    CASE WHEN e.enum_name IS NOT NULL THEN c.data_type
      WHEN data_type LIKE '%[]%' THEN '"' || coalesce(m.target, replace(data_type, '[]', '')) || '[]"'
      WHEN m.target IN ('varchar', 'char', 'numeric', 'decimal') AND data_type LIKE '%(%'
        THEN m.target || substr(data_type, strpos(data_type, '('))
      ELSE coalesce(m.target, 'text') END AS new_type
  FROM {source} c
  LEFT JOIN f_enums e ON e.schema_id = c.schema_id AND e.enum_name = c.data_type
  LEFT JOIN (SELECT * FROM {values(mapping.items(), 'k, target')}) m
    ON m.k = replace(split_part(data_type, '(', 1), '[]', '')"""


MAPPED = mapped()

TYPE_WARNINGS = f"""
  SELECT schema_id, table_name, column_name, CASE type_rule WHEN 'fallback'
      THEN 'Unknown type ''' || data_type || ''' converted to ''text'''
      ELSE 'Type ''' || data_type || ''' converted to ''text'' - ' || loss || ' types lose meaning' END AS message
  FROM mapped LEFT JOIN (SELECT * FROM {values(fixed.LOSSY_TYPES.items(), 'lossy, loss')}) v ON lossy = data_type
  WHERE type_rule = 'fallback' OR (type_rule = 'known' AND loss IS NOT NULL)"""

TYPE_LOG = f"""
  SELECT schema_id, table_name, column_name, data_type AS original_type, new_type,
    CASE WHEN data_type LIKE '%[]%' THEN '{fixed.ARRAY_REASON}'
      WHEN data_type IN {one_of(fixed.SPECIFIC_TYPES)} THEN '{fixed.SPECIFIC_REASON}'
      ELSE '{fixed.OTHER_REASON}' END AS reason
  FROM mapped WHERE data_type <> new_type"""


def _union(*queries: str) -> str:
    return "\nUNION ALL\n".join(queries)


_COLUMN_PLACE = "table_name || '.' || column_name"
COLUMN_FEATURES = _union(
    f"SELECT schema_id, 'ARRAY_TYPE' AS feature_type, 'CRITICAL' AS severity, {_COLUMN_PLACE} AS location, data_type FROM f_columns WHERE data_type LIKE '%[]%'",
    f"SELECT schema_id, 'UUID_FUNCTION', 'HIGH', {_COLUMN_PLACE}, data_type FROM f_columns WHERE default_value = 'gen_random_uuid()'",
    f"SELECT schema_id, 'NEGATIVE_DEFAULT', 'MEDIUM', {_COLUMN_PLACE}, data_type FROM f_columns WHERE default_value = '-1'")
TYPE_FEATURES = f"""
  SELECT schema_id, feature_type, severity, {_COLUMN_PLACE} AS location, data_type FROM f_columns
  JOIN (SELECT * FROM {values(fixed.TYPE_FEATURES, 't, feature_type, severity')}) x
    ON x.t = replace(split_part(data_type, '(', 1), '[]', '')"""
TABLE_FEATURES = _union(
    "SELECT schema_id, 'TABLE_INHERITANCE' AS feature_type, 'CRITICAL' AS severity, table_name AS location, '' AS data_type FROM f_tables WHERE table_no % 20 = 0",
    "SELECT schema_id, 'TABLE_PARTITIONING', 'CRITICAL', table_name, '' FROM f_tables WHERE table_no % 20 = 1")
_CONSTRAINT_PLACE = "table_name || '.' || constraint_name"
CONSTRAINT_FEATURES = _union(
    f"SELECT schema_id, 'CHECK_CONSTRAINT' AS feature_type, 'HIGH' AS severity, {_CONSTRAINT_PLACE} AS location, '' AS data_type FROM f_constraints WHERE constraint_type = 'c'",
    f"SELECT schema_id, 'DEFERRABLE_CONSTRAINT', 'HIGH', {_CONSTRAINT_PLACE}, '' FROM f_constraints WHERE definition LIKE '%DEFERRABLE%'",
    f"SELECT schema_id, 'EXCLUDE_CONSTRAINT', 'CRITICAL', {_CONSTRAINT_PLACE}, '' FROM f_constraints WHERE definition LIKE 'EXCLUDE%'")
_INDEX_PLACE = "table_name || '.' || index_name"
INDEX_FEATURES = _union(
    f"SELECT schema_id, 'PARTIAL_INDEX' AS feature_type, 'HIGH' AS severity, {_INDEX_PLACE} AS location, '' AS data_type FROM f_indexes WHERE definition LIKE '%WHERE%'",
    f"SELECT schema_id, 'EXPRESSION_INDEX', 'HIGH', {_INDEX_PLACE}, '' FROM f_indexes WHERE columns LIKE '%(%'",
    f"SELECT schema_id, 'CONCURRENT_INDEX', 'MEDIUM', {_INDEX_PLACE}, '' FROM f_indexes WHERE definition LIKE '%CONCURRENTLY%'",
    f"SELECT schema_id, 'OPERATOR_CLASS', 'HIGH', {_INDEX_PLACE}, '' FROM f_indexes WHERE columns LIKE '%gin_trgm_ops'")
RELATIONSHIP_FEATURES = _union(
    "SELECT schema_id, 'CASCADE_ACTION' AS feature_type, 'MEDIUM' AS severity, source_table || ' -> ' || target_table AS location, '' AS data_type FROM f_relationships WHERE on_delete = 'CASCADE' OR on_update = 'CASCADE'",
    "SELECT schema_id, 'COMPOSITE_FOREIGN_KEY', 'HIGH', source_table || ' -> ' || target_table, '' FROM f_relationships WHERE source_columns LIKE '%,%'")
FEATURES = _union(COLUMN_FEATURES, TYPE_FEATURES, TABLE_FEATURES, CONSTRAINT_FEATURES,
                  INDEX_FEATURES, RELATIONSHIP_FEATURES)
ROUTED_FEATURES = """
  SELECT *, CASE WHEN feature_type IN ('TABLE_INHERITANCE', 'TABLE_PARTITIONING', 'MULTIRANGE_TYPE', 'EXCLUDE_CONSTRAINT')
    THEN 'DROPPED' ELSE 'PROCESSED' END AS action FROM features"""
NEEDED_DECISIONS = f"""
  SELECT features.*, v.decision FROM features
  JOIN {values(fixed.FEATURE_DECISION.items(), 'feature_type, decision')} ON features.feature_type = v.feature_type"""

ROUTED = """
  SELECT *, CASE WHEN constraint_type IN ('c', 'x') THEN 'DROPPED'
      WHEN constraint_type = 'f' AND definition LIKE '%DEFERRABLE%' THEN 'MODIFIED' ELSE 'KEPT' END AS action,
    CASE WHEN constraint_type = 'c' THEN 'CHECK' WHEN constraint_type = 'x' THEN 'EXCLUDE'
      WHEN constraint_type = 'f' AND definition LIKE '%DEFERRABLE%' THEN 'FOREIGN_KEY_DEFERRABLE' ELSE '' END AS change,
    replace(definition, ' DEFERRABLE INITIALLY DEFERRED', '') AS new_definition
  FROM f_constraints"""
DROPS = f"""
  SELECT schema_id, table_name, constraint_name, r.change AS kind, v.reason, v.impact, definition
  FROM routed r JOIN {values([(k, *x) for k, x in fixed.DROP_REASONS.items()], 'change, reason, impact')}
    ON v.change = r.change WHERE action = 'DROPPED'"""
CONSTRAINT_WARNINGS = _union(
    "SELECT schema_id, 'Dropped ' || kind || ' constraint ''' || constraint_name || ''' on table ''' || table_name || ''': ' || reason AS message FROM drops",
    "SELECT schema_id, 'Modified constraint ''' || constraint_name || ''' on table ''' || table_name || ''': removed DEFERRABLE option' FROM routed WHERE action = 'MODIFIED'")

MISSING_TABLES = """
  SELECT schema_id, 'MISSING_TABLE' AS type, 'CRITICAL' AS severity, table_name, '' AS detail, CAST(1 AS BIGINT) AS lost_count,
    'Table ''' || table_name || ''' is not in the copy' AS description
  FROM (SELECT DISTINCT schema_id, table_name FROM f_tables) a
  WHERE NOT EXISTS (SELECT 1 FROM c_tables b WHERE b.schema_id = a.schema_id AND b.table_name = a.table_name)"""
MISSING_RELATIONSHIPS = """
  SELECT schema_id, 'MISSING_RELATIONSHIP' AS type, 'HIGH' AS severity, source_table AS table_name, target_table AS detail,
    CAST(1 AS BIGINT) AS lost_count, 'Relationship ' || source_table || ' -> ' || target_table || ' is not in the copy' AS description
  FROM (SELECT DISTINCT schema_id, source_table, target_table FROM f_relationships) a
  WHERE NOT EXISTS (SELECT 1 FROM c_relationships b WHERE b.schema_id = a.schema_id
    AND b.source_table = a.source_table AND b.target_table = a.target_table)"""
MISSING_CONSTRAINTS = f"""
  SELECT a.schema_id, 'MISSING_CONSTRAINT' AS type, CASE a.kind WHEN 'check' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    a.table_name, a.kind AS detail, a.n - coalesce(b.n, 0) AS lost_count,
    (a.n - coalesce(b.n, 0)) || ' ' || a.kind || ' constraint(s) fewer on table ''' || a.table_name || '''' AS description
  FROM (SELECT schema_id, table_name, v.kind, count(*) AS n FROM f_constraints
    JOIN {values(fixed.CONSTRAINT_KINDS.items(), 'letter, kind')} ON letter = constraint_type GROUP BY 1, 2, 3) a
  LEFT JOIN (SELECT schema_id, table_name, v.kind, count(*) AS n FROM c_constraints
    JOIN {values(fixed.CONSTRAINT_KINDS.items(), 'letter, kind')} ON letter = constraint_type GROUP BY 1, 2, 3) b
    ON b.schema_id = a.schema_id AND b.table_name = a.table_name AND b.kind = a.kind
  WHERE a.n > coalesce(b.n, 0) AND EXISTS (SELECT 1 FROM c_tables t WHERE t.schema_id = a.schema_id AND t.table_name = a.table_name)"""
HIDDEN_CASCADES = """
  SELECT schema_id, 'INVISIBLE_CASCADE' AS type, 'MEDIUM' AS severity, source_table AS table_name, target_table AS detail,
    CAST(1 AS BIGINT) AS lost_count, 'CASCADE ' || concat_ws('/', CASE WHEN on_delete = 'CASCADE' THEN 'DELETE' END,
      CASE WHEN on_update = 'CASCADE' THEN 'UPDATE' END) || ' of ' || source_table || ' -> ' || target_table
      || ' does not show' AS description
  FROM c_relationships WHERE on_delete = 'CASCADE' OR on_update = 'CASCADE'"""
MISSING_COLUMNS = """
  SELECT schema_id, 'MISSING_COLUMN' AS type, 'HIGH' AS severity, table_name, column_name AS detail, CAST(1 AS BIGINT) AS lost_count,
    'Column ''' || table_name || '.' || column_name || ''' is not in the copy' AS description
  FROM (SELECT DISTINCT schema_id, table_name, column_name FROM f_columns) a
  WHERE NOT EXISTS (SELECT 1 FROM c_columns b WHERE b.schema_id = a.schema_id AND b.table_name = a.table_name
      AND b.column_name = a.column_name)
    AND EXISTS (SELECT 1 FROM c_tables t WHERE t.schema_id = a.schema_id AND t.table_name = a.table_name)"""
def _with_impact(query: str) -> str:
    return f"SELECT l.*, v.impact FROM ({query}) l JOIN {values(fixed.LOSS_IMPACTS.items(), 'kind, impact')} ON v.kind = l.type"


MISSING_TABLES, MISSING_RELATIONSHIPS, MISSING_CONSTRAINTS, HIDDEN_CASCADES, MISSING_COLUMNS = map(
    _with_impact, [MISSING_TABLES, MISSING_RELATIONSHIPS, MISSING_CONSTRAINTS, HIDDEN_CASCADES, MISSING_COLUMNS])
LOSSES = _union(*[f"SELECT * FROM ({q})" for q in [
    MISSING_TABLES, MISSING_RELATIONSHIPS, MISSING_CONSTRAINTS, HIDDEN_CASCADES, MISSING_COLUMNS]])
SILENT = """
  SELECT * FROM losses l WHERE type = 'INVISIBLE_CASCADE' OR NOT EXISTS (
    SELECT 1 FROM f_warnings w WHERE w.schema_id = l.schema_id AND contains(w.message, l.table_name)
      AND CASE WHEN l.type = 'MISSING_CONSTRAINT' THEN contains(upper(w.message), upper(l.detail))
        ELSE contains(w.message, l.detail) END)"""

KEY_COLUMNS = """
  SELECT DISTINCT schema_id, table_name, column_name FROM (
    SELECT schema_id, table_name, column_name FROM f_columns WHERE is_primary_key
    UNION ALL SELECT schema_id, table_name, columns FROM f_constraints WHERE constraint_type = 'p') u"""
ISSUES = _union(
    "SELECT schema_id, 'INVALID_TABLE_NAME' AS issue_type, 'HIGH' AS severity, table_name AS subject FROM f_tables WHERE table_name LIKE '%-%'",
    f"SELECT schema_id, 'INVALID_COLUMN_NAME', 'HIGH', {_COLUMN_PLACE} FROM f_columns WHERE column_name LIKE '%-%'",
    f"SELECT schema_id, 'RESERVED_KEYWORD', 'MEDIUM', {_COLUMN_PLACE} FROM f_columns WHERE column_name = 'note'",
    f"SELECT schema_id, 'LONG_COLUMN_NAME', 'LOW', {_COLUMN_PLACE} FROM f_columns WHERE length(column_name) > 50",
    """SELECT schema_id, 'NO_PRIMARY_KEY', 'MEDIUM', table_name FROM f_tables t WHERE NOT EXISTS (
      SELECT 1 FROM key_columns k WHERE k.schema_id = t.schema_id AND k.table_name = t.table_name)""",
    f"SELECT schema_id, 'COMPLEX_DATA_TYPE', 'MEDIUM', {_COLUMN_PLACE} FROM f_columns WHERE data_type LIKE '%[]%' OR data_type LIKE '%(%,%)%'",
    "SELECT schema_id, 'COMPOSITE_RELATIONSHIP', 'HIGH', source_table || ' -> ' || target_table FROM f_relationships WHERE source_columns LIKE '%,%'",
    "SELECT schema_id, 'SELF_REFERENCING', 'MEDIUM', source_table || ' -> ' || target_table FROM f_relationships WHERE source_table = target_table",
    "SELECT schema_id, 'CASCADE_ACTION_INVISIBLE', 'MEDIUM', source_table || ' -> ' || target_table FROM f_relationships WHERE on_delete = 'CASCADE' OR on_update = 'CASCADE'")
SCORES = """
  SELECT schema_id, count(issue_type) AS n_issues, count(*) FILTER (severity = 'HIGH') AS n_high,
    greatest(0, 1 - coalesce(sum(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END), 0)
      / greatest(count(issue_type) * 3, 10)) AS score
  FROM (SELECT DISTINCT schema_id FROM f_tables) s LEFT JOIN issues USING (schema_id) GROUP BY 1"""

VALIDATED = """
  SELECT r.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM f_tables t WHERE t.schema_id = r.schema_id AND t.table_name = r.source_table) THEN 'MISSING_SOURCE_TABLE'
    WHEN NOT EXISTS (SELECT 1 FROM f_tables t WHERE t.schema_id = r.schema_id AND t.table_name = r.target_table) THEN 'MISSING_TARGET_TABLE'
    WHEN (SELECT count(DISTINCT c.column_name) FROM f_columns c WHERE c.schema_id = r.schema_id AND c.table_name = r.source_table
      AND list_contains(string_split(r.source_columns, ','), c.column_name)) < len(string_split(r.source_columns, ',')) THEN 'MISSING_SOURCE_COLUMNS'
    WHEN (SELECT count(DISTINCT c.column_name) FROM f_columns c WHERE c.schema_id = r.schema_id AND c.table_name = r.target_table
      AND list_contains(string_split(r.target_columns, ','), c.column_name)) < len(string_split(r.target_columns, ',')) THEN 'MISSING_TARGET_COLUMNS'
    WHEN len(string_split(r.source_columns, ',')) <> len(string_split(r.target_columns, ',')) THEN 'COLUMN_COUNT_MISMATCH' END AS skip_type
  FROM f_relationships r"""
UNIQUE_KEYS = """
  SELECT DISTINCT * FROM (
    SELECT schema_id, table_name, string_agg(DISTINCT columns, ',' ORDER BY columns) AS k FROM f_constraints WHERE constraint_type = 'p' GROUP BY 1, 2
    UNION ALL SELECT schema_id, table_name, columns FROM f_constraints WHERE constraint_type = 'u'
    UNION ALL SELECT schema_id, table_name, column_name FROM f_columns WHERE is_unique OR is_primary_key) u"""
TYPED = """
  SELECT r.*, CASE WHEN s.k IS NOT NULL AND t.k IS NOT NULL THEN 'one-to-one' ELSE 'many-to-one' END AS relationship_type,
    t.k IS NOT NULL AS target_is_unique
  FROM (SELECT * FROM validated WHERE skip_type IS NULL) r
  LEFT JOIN unique_keys s ON s.schema_id = r.schema_id AND s.table_name = r.source_table AND s.k = r.source_columns
  LEFT JOIN unique_keys t ON t.schema_id = r.schema_id AND t.table_name = r.target_table AND t.k = r.target_columns"""
BUILT = """
  SELECT schema_id, source_table, source_columns, target_table, target_columns, min(rel_no) AS rel_no,
    min_by(on_delete, rel_no) AS on_delete, min_by(on_update, rel_no) AS on_update, min(relationship_type) AS relationship_type,
    bool_and(target_is_unique) AS target_is_unique, count(*) - 1 AS n_removed
  FROM typed GROUP BY 1, 2, 3, 4, 5"""
