"""Lines of scripts and diagrams: classification, removal, assembly, lint and repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.functions import text
from attestor.functions.names import strip
from attestor.functions.text import NOT_W, W


def explode_lines(scripts: DataFrame) -> DataFrame:
    """The lines of each script, numbered from 1."""
    return (scripts.select("script_id", F.posexplode(F.split("sql", "\n")).alias("_p", "line"))
            .select("script_id", (F.col("_p") + 1).alias("line_no"), "line"))


def removal_rules(line: Column) -> list[tuple[Column, str]]:
    """(condition, statement type) in the order in which they are tried."""
    bare = strip(line)
    upper = F.upper(bare)

    def starts(*words: str) -> Column:
        return upper.rlike("^(" + "|".join(words) + ") ")

    return [
        (F.startswith(bare, F.lit("\\")), "PSQL_COMMAND"),
        (starts("SET"), "SET"),
        (starts("SELECT"), "SELECT"),
        (starts("COMMENT ON"), "COMMENT"),
        (starts("COPY"), "COPY"),
        (starts("GRANT", "REVOKE"), "PERMISSION"),
        (F.contains(upper, F.lit("OWNER TO")), "OWNERSHIP"),
        (F.contains(upper, F.lit("OWNED BY")), "SEQUENCE_OWNERSHIP"),
        (starts("ALTER TABLE ONLY") & F.contains(upper, F.lit("SET DEFAULT")), "COLUMN_DEFAULT"),
    ]


def classify_lines(lines: DataFrame,
                   rules: Callable[[Column], list[tuple[Column, str]]] = removal_rules) -> DataFrame:
    """Add the statement type for which a line is removed, or null if it stays."""
    line = F.col("line")
    bare = strip(line)
    kind = F.when((bare == "") | F.startswith(bare, F.lit("--")), F.lit(None).cast("string"))
    for condition, name in rules(line):
        kind = kind.when(condition, name)
    return lines.withColumn("statement_type", kind)


def drop_lines(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("statement_type").isNull()).drop("statement_type")


def line_map(kept: DataFrame, width: int = scale.BLOCK) -> DataFrame:
    """New line number and original line number of each kept line."""
    return scale.numbered(kept.select("script_id", "line_no"), ["script_id"], "line_no", "new_no", width)


def removal_log(classified: DataFrame) -> DataFrame:
    """Each removed line as a whole, with a preview of 100 characters and the reason."""
    reasons = scale.dimension(classified, fixed.REMOVAL_REASONS, ["statement_type", "reason"])
    return (classified.filter(F.col("statement_type").isNotNull()).join(reasons, "statement_type")
            .select("script_id", "line_no", "statement_type",
                    strip(F.col("line")).alias("content"),
                    F.substring(strip(F.col("line")), 1, fixed.REMOVED_PREVIEW).alias("preview"), "reason"))


def removal_report(log: DataFrame) -> DataFrame:
    """Removed lines per script: by type and in all ('ALL')."""
    return (log.groupingSets([["script_id", "statement_type"], ["script_id"]], "script_id", "statement_type")
            .agg(F.count("*").alias("n_removed"))
            .withColumn("statement_type", F.coalesce("statement_type", F.lit("ALL"))))


def join_lines(lines: DataFrame, per_part: int = fixed.LINES_PER_PART) -> DataFrame:
    """The lines of each script joined in order, in numbered parts of so many lines."""
    return (scale.parts(lines, ["script_id"], "line_no", "line", "\n", per_part)
            .withColumnsRenamed({"line": "sql", "n_pieces": "n_lines"}))


def modification_report(scripts: DataFrame) -> DataFrame:
    """How many scripts each preparation pass changes; the passes run in order."""
    states = scripts.select(F.col("sql").alias("_0"))
    for n, rewrite in enumerate(text.PREPARATION.values()):
        states = states.withColumn(f"_{n + 1}", rewrite(F.col(f"_{n}")))
    counts = [F.struct(F.lit(name).alias("modification"),
                       F.count_if(F.col(f"_{n}") != F.col(f"_{n + 1}")).alias("n_changed"))
              for n, name in enumerate(text.PREPARATION)]
    return states.agg(F.array(*counts).alias("c")).select(F.inline("c"))


# --- lint -----------------------------------------------------------------------------------

def _words(name: str) -> str:
    """A name of several words, in any case and with any blanks between them."""
    return "(?i)" + r"\s+".join(name.split())


_END = rf"{W}+\.{W}+"  # one end of a relationship


def lint_lines(lines: DataFrame) -> DataFrame:
    """Findings (doc, line_no, rule, severity, line) of all line rules, in one pass."""
    bare = F.col("_bare")

    def finding(rule: str, severity: str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))

    found = scale.rules(
        (bare.rlike(rf"^Table\s+{W}+\["), finding("TABLE_SETTINGS_SPACING", "ERROR")),
        (F.startswith(bare, F.lit("[")) & ~F.startswith(bare, F.lit("[headercolor")),
         finding("BRACKET_PLACEMENT", "WARNING")),
        (bare.rlike(rf"default:\s*-[0-9]+{NOT_W}"), finding("UNQUOTED_NEGATIVE_DEFAULT", "ERROR")),
        (bare.rlike(rf"{W}\[\](\S|\z)") & ~F.contains(bare, F.lit('"')), finding("UNQUOTED_ARRAY_TYPE", "ERROR")),
        *[(bare.rlike(_words(name)), finding("MULTI_WORD_TYPE", "ERROR")) for name in fixed.LINTED_TYPES],
        (bare.rlike(rf"default:\s*{W}+\(\)") & ~F.contains(bare, F.lit("`")), finding("UNQUOTED_FUNCTION_CALL", "ERROR")),
        (F.startswith(bare, F.lit("Ref:")) & ~bare.rlike(rf"Ref:\s+{_END}\s+[>-]\s+{_END}"),
         finding("INCOMPLETE_RELATIONSHIP", "WARNING")))
    return (lines.withColumn("_bare", strip(F.col("line")))
            .filter((bare != "") & ~F.startswith(bare, F.lit("//")))
            .select("doc", "line_no", F.explode(found).alias("f"), bare.alias("line"))
            .select("doc", "line_no", "f.rule", "f.severity", "line"))


def lint_docs(lines: DataFrame) -> DataFrame:
    """Findings about whole documents, from counts over their lines; nothing is joined up."""
    def count(mark: str) -> Column:
        return F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))

    counts = scale.tally(["doc"], (lines, {
        "_tables": F.contains("line", F.lit("Table ")), "_projects": F.contains("line", F.lit("Project ")),
        "_open": count("{"), "_closed": count("}")}))

    def finding(rule: str, severity: str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))

    found = scale.rules(
        (F.col("_tables") == 0, finding("NO_TABLES", "WARNING")),
        (F.col("_open") != F.col("_closed"), finding("UNMATCHED_BRACES", "ERROR")),
        (F.col("_projects") == 0, finding("NO_PROJECT_DEFINITION", "WARNING")))
    return (counts.select("doc", F.explode(found).alias("f"))
            .select("doc", F.lit(0).cast("long").alias("line_no"), "f.rule", "f.severity", F.lit("").alias("line")))


def lint_verdict(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Errors and warnings of every document; it is valid without errors."""
    counts = scale.tally(["doc"], (docs, {}), (issues, {
        "n_errors": F.col("severity") == "ERROR", "n_warnings": F.col("severity") == "WARNING"}))
    return counts.withColumn("is_valid", F.col("n_errors") == 0)


def lint_top(issues: DataFrame, errors: int = 5, warnings: int = 3) -> DataFrame:
    """The first errors and warnings of each document, and how many more there are."""
    keys, order = ["doc", "severity"], ["line_no", "rule"]
    return (scale.first_rows_and_total(issues.filter("severity = 'ERROR'"), keys, order, errors)
            .unionByName(scale.first_rows_and_total(issues.filter("severity = 'WARNING'"), keys, order, warnings)))


# (fix, pattern, replacement) in the order in which they are applied
REPAIRS = [
    ("TABLE_SETTINGS_SPACING", rf"(Table\s+{W}+)\[", "$1 ["),
    ("NEGATIVE_DEFAULTS", rf"(default:\s*)(-[0-9]+)(?!{W})", "$1'$2'"),
    ("ARRAY_TYPE_QUOTING", rf"({W}+)\[\](?!\s)", '"$1 []"'),
    *[(f"MULTI_WORD_TYPE {short}", _words(name), short) for name, short in fixed.LINTED_TYPES.items()],
    ("BRACKET_LINE_BREAKS", r"\n\s*\[", " ["),
]


def repair_docs(docs: DataFrame) -> DataFrame:
    """Apply the fixes in order to ``text``; ``fixes`` names those whose pattern occurred."""
    out = docs.withColumn("fixes", F.array().cast("array<string>"))
    for name, pattern, replacement in REPAIRS:
        occurs = F.col("text").rlike(pattern)
        out = out.withColumns({
            "fixes": F.when(occurs, F.array_append("fixes", F.lit(name))).otherwise(F.col("fixes")),
            "text": F.regexp_replace("text", pattern, replacement)})
    return out
