"""Which constraints a diagram can hold, and what becomes of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.functions.names import strip

_DEFERRABLE = r"(?i)\s+DEFERRABLE(\s+INITIALLY\s+(DEFERRED|IMMEDIATE))?\s*"


def strip_deferrable(definition: Column) -> Column:
    """The definition without its deferrable option."""
    return F.when(F.contains(F.upper(definition), F.lit("DEFERRABLE")),
                  strip(F.regexp_replace(definition, _DEFERRABLE, " "))).otherwise(definition)


def route_constraints(constraints: DataFrame) -> DataFrame:
    """Mark each constraint KEPT, MODIFIED or DROPPED, with the kind of what is dropped.

    The kept set is ``action <> 'DROPPED'`` with ``new_definition``.
    """
    kind, definition = F.col("constraint_type"), F.upper("definition")
    deferrable = F.coalesce(F.contains(definition, F.lit("DEFERRABLE")), F.lit(False))
    action = (F.when(kind.isin("p", "u"), "KEPT").when((kind == "f") & deferrable, "MODIFIED")
              .when(kind == "f", "KEPT").otherwise("DROPPED"))
    dropped_kind = (F.when(kind == "c", "CHECK").when(F.startswith(definition, F.lit("EXCLUDE")), "EXCLUDE")
                    .otherwise("UNKNOWN"))
    return constraints.withColumns({
        "action": action,
        "change": F.when(action == "DROPPED", dropped_kind).when(action == "MODIFIED", "FOREIGN_KEY_DEFERRABLE")
        .otherwise(""),
        "new_definition": F.when(action == "MODIFIED", strip_deferrable(F.col("definition")))
        .otherwise(F.col("definition")),
        "constraint_name": F.coalesce("constraint_name", F.lit("unnamed"))})


def modification_log(routed: DataFrame) -> DataFrame:
    """Each changed constraint with its text before and after."""
    return routed.filter("action = 'MODIFIED'").select(
        "schema_id", "table_name", "constraint_name", "change", "definition", "new_definition")


def drop_log(routed: DataFrame) -> DataFrame:
    """Each dropped constraint with reason and impact."""
    reasons = scale.dimension(routed, [(k, *v) for k, v in fixed.DROP_REASONS.items()],
                              ["change", "reason", "impact"])
    return routed.filter("action = 'DROPPED'").join(reasons, "change").select(
        "schema_id", "table_name", "constraint_name", F.col("change").alias("kind"), "reason",
        "impact", "definition")


def constraint_warnings(routed: DataFrame) -> DataFrame:
    """One message per drop, per modification and per composite foreign key."""
    reasons = F.create_map(*[F.lit(x) for k, v in fixed.DROP_REASONS.items() for x in (k, v[0])])
    composite = (F.col("constraint_type") == "f") & (F.size("columns") > 1)
    messages = scale.rules(
        (F.col("action") == "DROPPED", F.format_string(
            "Dropped %s constraint '%s' on table '%s': %s", "change", "constraint_name", "table_name",
            reasons[F.col("change")])),
        (F.col("action") == "MODIFIED", F.format_string(
            "Modified constraint '%s' on table '%s': removed DEFERRABLE option", "constraint_name", "table_name")),
        (composite, F.format_string(
            "Composite foreign key '%s' on table '%s' - verify import", "constraint_name", "table_name")))
    return routed.select("schema_id", F.lit("constraint").alias("source"), F.explode(messages).alias("message"))


def apply_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Carry declared keys over to the columns.

    Columns of a primary key become not null, and unique if the key has one column; a unique
    constraint marks its column only if it is the only one.
    """
    single = F.size("columns") == 1
    keys = ["schema_id", "table_name", "column_name"]
    marks = (constraints.filter(F.col("constraint_type").isin("p", "u"))
             .select("schema_id", "table_name", F.explode("columns").alias("column_name"),
                     (F.col("constraint_type") == "p").alias("_p"), single.alias("_single"))
             .groupBy(*keys).agg(F.bool_or("_p").alias("_pk"), F.bool_or("_single").alias("_unique")))
    no = F.lit(False)
    is_key = F.coalesce("_pk", no)
    return columns.join(marks, keys, "left").withColumns({
        "is_nullable": F.col("is_nullable") & ~is_key,
        "is_primary_key": F.col("is_primary_key") | is_key,
        "is_unique": F.col("is_unique") | F.coalesce("_unique", no)}).drop("_pk", "_unique")


def constraint_report(routed: DataFrame) -> DataFrame:
    """Counts per schema: by action and kind, by action, and in all; 'ALL' marks sums."""
    return (routed.groupingSets(
        [["schema_id", "action", "change"], ["schema_id", "action"], ["schema_id"]],
        "schema_id", "action", "change")
        .agg(F.count("*").alias("n_constraints"))
        .withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ["action", "change"]}))
