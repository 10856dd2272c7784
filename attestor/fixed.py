"""Lists, lookup tables and thresholds that results depend on.

Everything here is small and constant, so a table built from it may be broadcast.
"""

# --- fixed values: script lines -------------------------------------------------------------

# (statement type, reason for removal)
REMOVAL_REASONS = [
    ("PSQL_COMMAND", "client command"),
    ("SET", "configuration statement"),
    ("SELECT", "query statement"),
    ("COMMENT", "comment statement"),
    ("COPY", "data import statement"),
    ("PERMISSION", "permission statement"),
    ("OWNERSHIP", "ownership statement"),
    ("SEQUENCE_OWNERSHIP", "sequence ownership statement"),
    ("COLUMN_DEFAULT", "default is read from the table definition"),
    ("UNKNOWN", "statement not representable"),
]

# multi-word type name -> alias, applied in this order
MULTI_WORD_ALIASES = [
    ("timestamp with time zone", "timestamptz"),
    ("timestamp without time zone", "timestamp"),
    ("time with time zone", "timetz"),
    ("time without time zone", "time"),
    ("double precision", "float8"),
    ("character varying", "varchar"),
]

# words before which the whitespace pass breaks the line
STATEMENT_WORDS = ["CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE"]

# what a reference may do
REFERENCE_ACTIONS = ["CASCADE", "RESTRICT", "SET NULL", "SET DEFAULT", "NO ACTION"]

REMOVED_PREVIEW, FAILED_PREVIEW = 100, 200
# above this size a script is labelled; nothing is refused
MAX_SCRIPT_BYTES = 50 * 1024 * 1024
LINES_PER_PART, TABLES_PER_PART = 10_000, 1000

# --- fixed values: types --------------------------------------------------------------------

# type name -> diagram type
TYPE_MAP = {
    "integer": "int4", "int": "int4", "int4": "int4",
    "bigint": "int8", "int8": "int8",
    "smallint": "int2", "int2": "int2",
    "boolean": "bool", "bool": "bool",
    "text": "text", "varchar": "varchar", "char": "bpchar", "bpchar": "bpchar",
    "date": "date", "timestamp": "timestamp", "timestamptz": "timestamptz",
    "time": "time", "timetz": "timetz", "interval": "interval",
    "json": "json", "jsonb": "jsonb", "uuid": "uuid",
    "numeric": "numeric", "decimal": "numeric",
    "real": "float4", "float4": "float4",
    "float8": "float8", "float": "float8", "double": "float8",
    "serial": "int4", "bigserial": "int8", "smallserial": "int2",
    "inet": "inet", "cidr": "cidr", "macaddr": "macaddr", "macaddr8": "macaddr8",
    "point": "point", "line": "line", "lseg": "lseg", "box": "box",
    "path": "path", "polygon": "polygon", "circle": "circle",
    "bytea": "bytea", "money": "money",
    "int4range": "int4range", "int8range": "int8range", "numrange": "numrange",
    "tsrange": "tsrange", "tstzrange": "tstzrange", "daterange": "daterange",
    "tsvector": "tsvector", "tsquery": "tsquery", "xml": "xml", "pg_lsn": "pg_lsn",
    "bit": "bit", "varbit": "varbit",
    "int4multirange": "text", "int8multirange": "text", "nummultirange": "text",
    "tsmultirange": "text", "datemultirange": "text",
    "hstore": "text", "ltree": "text", "cube": "text", "isbn": "text", "issn": "text",
}

# the stricter profile
STRICT_TYPE_MAP = {
    "integer": "integer", "bigint": "bigint", "smallint": "integer",
    "boolean": "boolean", "text": "text", "varchar": "varchar", "char": "char",
    "date": "date", "timestamp": "timestamp", "timestamptz": "timestamptz", "time": "time",
    "json": "json", "jsonb": "json", "uuid": "uuid",
    "numeric": "numeric", "decimal": "decimal", "real": "float", "float8": "float",
    "money": "decimal", "interval": "varchar",
    "serial": "integer", "bigserial": "bigint", "smallserial": "integer",
    "inet": "text", "cidr": "text", "macaddr": "text", "macaddr8": "text",
    "tsvector": "text", "tsquery": "text", "xml": "text",
    "point": "text", "line": "text", "polygon": "text", "circle": "text",
    "bytea": "text", "bit": "text", "varbit": "text",
    "int4multirange": "text", "int8multirange": "text", "nummultirange": "text",
    "tsmultirange": "text", "datemultirange": "text",
}

# targets that keep their parameters
PARAMETER_TARGETS = ["varchar", "char", "numeric", "decimal"]

# type -> kind of meaning lost when it becomes text
LOSSY_TYPES = {
    "int4multirange": "multirange", "int8multirange": "multirange",
    "nummultirange": "multirange", "tsmultirange": "multirange", "datemultirange": "multirange",
    "hstore": "hstore extension", "ltree": "ltree extension", "cube": "cube extension",
    "isbn": "ISBN extension", "issn": "ISSN extension",
}

# reasons of a type change
ARRAY_REASON = "Array type syntax incompatibility"
SPECIFIC_REASON = "PostgreSQL-specific type not supported in DBML"
MULTI_WORD_REASON = "Multi-word type converted to alias"
OTHER_REASON = "DBML compatibility"
SPECIFIC_TYPES = ["inet", "cidr", "macaddr", "tsvector", "xml"]

# type families that are features: (type, feature type, severity)
TYPE_FEATURES = (
    [(t, "GEOMETRIC_TYPE", "HIGH")
     for t in ["point", "line", "lseg", "box", "path", "polygon", "circle"]]
    + [(t, "NETWORK_TYPE", "HIGH") for t in ["inet", "cidr", "macaddr", "macaddr8"]]
    + [(t, "RANGE_TYPE", "HIGH")
       for t in ["int4range", "int8range", "numrange", "tsrange", "tstzrange", "daterange"]]
    + [(t, "MULTIRANGE_TYPE", "CRITICAL")
       for t in ["int4multirange", "int8multirange", "nummultirange",
                 "tsmultirange", "tstzmultirange", "datemultirange"]]
    + [(t, "TEXT_SEARCH_TYPE", "HIGH") for t in ["tsvector", "tsquery"]]
    + [(t, "POSTGRESQL_SPECIFIC_TYPE", "MEDIUM")
       for t in ["xml", "money", "bytea", "bit", "varbit"]]
)

# --- fixed values: severities, features, decisions ------------------------------------------

SEVERITY_RANK = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1, "LOW": 0}

# feature type -> what is lost
FEATURE_IMPACT = {
    "ARRAY_TYPE": "syntax errors without quoting",
    "UUID_FUNCTION": "parser error",
    "NEGATIVE_DEFAULT": "parser error",
    "GEOMETRIC_TYPE": "type becomes text",
    "NETWORK_TYPE": "type semantics lost",
    "RANGE_TYPE": "range semantics lost",
    "MULTIRANGE_TYPE": "feature completely lost",
    "TEXT_SEARCH_TYPE": "full-text search lost",
    "POSTGRESQL_SPECIFIC_TYPE": "type-specific features lost",
    "TABLE_INHERITANCE": "inheritance hierarchy lost",
    "TABLE_PARTITIONING": "partitioning strategy lost",
    "CHECK_CONSTRAINT": "validation logic lost",
    "DEFERRABLE_CONSTRAINT": "deferred checking lost",
    "EXCLUDE_CONSTRAINT": "exclusion logic lost",
    "PARTIAL_INDEX": "conditional index lost",
    "EXPRESSION_INDEX": "function index lost",
    "CONCURRENT_INDEX": "creation mode lost",
    "OPERATOR_CLASS": "index strategy lost",
    "CASCADE_ACTION": "referential behaviour hidden",
    "COMPOSITE_FOREIGN_KEY": "relationship may be lost",
}

# feature type -> decision it belongs to
FEATURE_DECISION = {
    "ARRAY_TYPE": "ARRAY_TYPE",
    "POSTGRESQL_SPECIFIC_TYPE": "UNKNOWN_TYPE_FALLBACK",
    "GEOMETRIC_TYPE": "UNKNOWN_TYPE_FALLBACK",
    "NETWORK_TYPE": "UNKNOWN_TYPE_FALLBACK",
    "CHECK_CONSTRAINT": "CHECK_CONSTRAINT_ACTION",
    "PARTIAL_INDEX": "COMPLEX_INDEX_ACTION",
    "EXPRESSION_INDEX": "COMPLEX_INDEX_ACTION",
    "OPERATOR_CLASS": "COMPLEX_INDEX_ACTION",
    "TABLE_INHERITANCE": "INHERITANCE_ACTION",
    "TABLE_PARTITIONING": "PARTITIONING_ACTION",
}

# decision -> default choice
DEFAULT_DECISIONS = {
    "ARRAY_TYPE": "quoted",
    "UNKNOWN_TYPE_FALLBACK": "text",
    "CHECK_CONSTRAINT_ACTION": "drop",
    "COMPLEX_INDEX_ACTION": "simplify",
    "INHERITANCE_ACTION": "flatten",
    "PARTITIONING_ACTION": "separate_tables",
}

# --- fixed values: constraints --------------------------------------------------------------

# dropped kind -> (reason, impact)
DROP_REASONS = {
    "CHECK": ("CHECK constraints not supported", "validation logic lost"),
    "EXCLUDE": ("EXCLUDE constraints not supported", "exclusion logic lost"),
    "UNKNOWN": ("unknown constraint type not supported", "constraint logic lost"),
}

# constraint letter -> kind used in count comparison
CONSTRAINT_KINDS = {"c": "check", "u": "unique", "f": "foreign_key", "p": "primary_key"}

# --- fixed values: names --------------------------------------------------------------------

# words that must not name a column in the diagram language
DIAGRAM_WORDS = ["table", "ref", "enum", "project", "note", "indexes",
                 "and", "or", "not", "null", "true", "false"]

# words that are quoted when they name something
QUOTED_WORDS = [
    "select", "from", "where", "table", "column", "index", "key",
    "primary", "foreign", "references", "unique", "check", "default",
    "null", "not", "and", "or", "in", "exists", "between", "like",
    "order", "group", "having", "limit", "offset", "join", "left",
    "right", "inner", "outer", "cross", "union", "except", "intersect",
    "insert", "update", "delete", "truncate", "create", "alter", "drop",
]

LONG_COLUMN_NAME = 50
MAX_IDENTIFIER = 63
MAX_RELATIONSHIP_COLUMNS = 10

# table group -> words that put a table into it
TABLE_GROUPS = {
    "User Management": ["user", "auth", "login", "session", "account"],
    "E-commerce": ["order", "product", "cart", "payment", "invoice"],
    "Content Management": ["post", "article", "content", "blog", "comment"],
    "System & Logging": ["log", "audit", "config", "setting", "admin"],
}

# --- fixed values: scores -------------------------------------------------------------------

# lower end of each yield band, and the sigma level there
SIGMA_BANDS = [
    (6.0, 0.9999966),
    (5.0, 0.999968),
    (4.0, 0.99966),
    (3.0, 0.9973),
    (2.0, 0.9545),
    (1.0, 0.8413),
]

# sigma level and compatibility at least, grade
QUALITY_GRADES = [
    (6.0, 0.95, "EXCELLENT"),
    (5.0, 0.90, "GOOD"),
    (4.0, 0.80, "ACCEPTABLE"),
    (3.0, 0.70, "POOR"),
]
WORST_GRADE = "UNACCEPTABLE"

# compatibility score at least, grade
SCORE_GRADES = [(0.95, "EXCELLENT"), (0.85, "GOOD"), (0.70, "ACCEPTABLE")]
WORST_SCORE_GRADE = "POOR"

# a column whose type contains one of these is expected to raise a warning
EXPECTED_LOSS_WORDS = ["inet", "cidr", "tsvector", "xml", "point", "polygon",
                       "hstore", "ltree", "cube"]

# (part of the old type, part of the new type): such changes need no warning
STANDARD_CHANGES = [
    ("bigserial", "int8"), ("bigserial", "bigint"),
    ("serial", "int4"), ("serial", "integer"),
    ("smallserial", "int2"), ("smallserial", "smallint"),
    ("smallint", "int2"), ("integer", "int4"), ("bigint", "int8"),
    ("boolean", "bool"), ("real", "float4"), ("float", "float8"), ("int", "int4"),
    ("double precision", "float8"), ("character varying", "varchar"),
    ("char", "bpchar"), ("decimal", "numeric"),
    ("oid", "text"), ("tid", "text"), ("xid", "text"), ("cid", "text"),
    ("complex_number", "text"), ("inventory_item", "text"), ("email_address", "text"),
    ("us_postal_code", "text"), ("percentage", "text"), ("positive_integer", "text"),
    ("bit", "bit"), ("integer[3][3]", "text"), ('"integer', "text"), ('"text', "text"),
]

# issue type -> advice
COMPATIBILITY_ADVICE = {
    "COMPOSITE_RELATIONSHIP": "split composite foreign keys",
    "COMPLEX_DATA_TYPE": "simplify complex data types",
    "NO_PRIMARY_KEY": "add primary keys",
    "CASCADE_ACTION_INVISIBLE": "document cascade actions separately",
}
NO_ADVICE = "schema appears highly compatible"

# --- fixed values: run log ------------------------------------------------------------------

# error class -> severity; any other class is CRITICAL
ERROR_SEVERITY = {
    "PreprocessingError": "HIGH",
    "ParsingError": "HIGH",
    "TransformationError": "MEDIUM",
    "GenerationError": "MEDIUM",
    "Warning": "MEDIUM",
}

# --- fixed values: diagram text -------------------------------------------------------------

HEADER = [
    "// Schema diagram",
    "// WARNING: this text holds less than the database - see the report",
    "",
    "Project postgresql_schema {",
    "  database_type: 'PostgreSQL'",
    "  Note: '''",
    "    Some features may be missing or simplified.",
    "  '''",
    "}",
    "",
]
TABLE_SETTINGS = "[headercolor: #3498DB]"
PLACEHOLDER = "_placeholder text [note: 'Partition table - columns inherited from parent']"

# class of the referential action -> colour of the line
ACTION_COLOURS = {"cascade": "#E74C3C", "restrict": "#F39C12", "set": "#3498DB", "other": "#79AD51"}

# advice of the report
REPORT_ADVICE = {
    "low_sigma": "review silent failures and constraint handling",
    "dropped_features": "document dropped features separately",
    "array_types": "verify that quoted array types display correctly",
    "dropped_checks": "implement dropped CHECK logic in the application",
}
NO_REPORT_ADVICE = "no specific recommendations"

# what each type of loss means
LOSS_IMPACTS = {
    "MISSING_TABLE": "a whole table and all that refers to it",
    "MISSING_RELATIONSHIP": "a foreign key between two tables",
    "MISSING_CONSTRAINT": "rules that kept the rows of a table sound",
    "INVISIBLE_CASCADE": "deletions or updates spread to other rows unseen",
    "MISSING_COLUMN": "the definition of a column"}

# types of several words that a diagram cannot hold, and what stands for them
LINTED_TYPES = {"double precision": "float8", "timestamp with time zone": "timestamptz",
                "timestamp without time zone": "timestamp", "character varying": "varchar"}
