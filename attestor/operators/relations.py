"""Validation, cardinality and duplicates of declared relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import scale
from attestor.session import written

SIGNATURE = ["schema_id", "source_table", "source_columns", "target_table", "target_columns"]
TABLE = ["schema_id", "table_name"]


def _endpoints(relationships: DataFrame, side: str) -> DataFrame:
    """One row per column of an endpoint, and one without a column for its table."""
    def end(is_table: bool, name: Column) -> Column:
        return F.struct(F.lit(is_table).alias("_is_table"), name.alias("column_name"))

    columns = F.transform(F.coalesce(f"{side}_columns", F.array().cast("array<string>")), lambda c: end(False, c))
    return relationships.select(*SIGNATURE, F.lit(side).alias("_side"), F.col(f"{side}_table").alias("table_name"),
                                F.inline(F.concat(F.array(end(True, F.lit(""))), columns)))


def validate_relationships(relationships: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Add ``skip_type``: the first of five checks that fails, or null.

    Each distinct relationship is checked once. Its tables and columns become rows that are
    matched with the catalog by equality, so no list of columns is built per table. A null
    table is a missing one, a null list or a null in a list a missing column.
    """
    known = (columns.select(*TABLE, F.lit(False).alias("_is_table"), "column_name")
             .unionByName(tables.select(*TABLE, F.lit(True).alias("_is_table"), F.lit("").alias("column_name"))).distinct()
             .withColumn("_known", F.lit(True)))
    distinct = relationships.select(*SIGNATURE).distinct()
    ends = _endpoints(distinct, "source").unionByName(_endpoints(distinct, "target"))
    missing = F.col("_known").isNull()

    def lacks(side: str, table: bool) -> Column:
        return F.bool_or(missing & (F.col("_side") == side) & (F.col("_is_table") == table))

    found = (ends.join(known, [*TABLE, "_is_table", "column_name"], "left").groupBy(*SIGNATURE).agg(
        lacks("source", True).alias("_st"), lacks("target", True).alias("_tt"),
        lacks("source", False).alias("_sc"), lacks("target", False).alias("_tc")))
    skip = (F.when(F.col("_st"), "MISSING_SOURCE_TABLE").when(F.col("_tt"), "MISSING_TARGET_TABLE")
            .when(F.col("_sc") | F.isnull("source_columns"), "MISSING_SOURCE_COLUMNS")
            .when(F.col("_tc") | F.isnull("target_columns"), "MISSING_TARGET_COLUMNS")
            .when(F.size("source_columns") != F.size("target_columns"), "COLUMN_COUNT_MISMATCH"))
    verdicts = found.select(*[F.col(c).alias(f"_{c}") for c in SIGNATURE], skip.alias("skip_type"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SIGNATURE])
    return relationships.join(verdicts, same).drop(*[f"_{c}" for c in SIGNATURE])


def unique_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """The sorted column lists that are unique in each table.

    All primary-key constraints of a table make one key together; a key list is a set, and
    as long as one declared key.
    """
    primary = (constraints.filter("constraint_type = 'p'")
               .select(*TABLE, F.explode("columns").alias("_c")).groupBy(*TABLE)
               .agg(F.array_sort(F.collect_set("_c")).alias("key")))
    unique = constraints.filter("constraint_type = 'u'").select(
        *TABLE, F.array_sort(F.array_distinct("columns")).alias("key"))
    single = columns.filter("is_unique OR is_primary_key").select(*TABLE, F.array("column_name").alias("key"))
    return primary.unionByName(unique).unionByName(single).distinct()


def relationship_type(valid: DataFrame, keys: DataFrame) -> DataFrame:
    """Add the declared cardinality, and whether the target columns are unique."""
    def marked(df: DataFrame, side: str) -> DataFrame:
        match = keys.select("schema_id", F.col("table_name").alias(f"{side}_table"),
                            F.col("key").alias("_key"), F.lit(True).alias(f"_{side}_unique"))
        own = F.array_sort(F.array_distinct(F.col(f"{side}_columns")))
        return (df.withColumn("_key", own)
                .join(match, ["schema_id", f"{side}_table", "_key"], "left").drop("_key"))

    both = marked(marked(valid, "source"), "target")
    source, target = F.col("_source_unique").isNotNull(), F.col("_target_unique").isNotNull()
    return both.withColumns({
        "relationship_type": F.when(source & target, "one-to-one").otherwise("many-to-one"),
        "target_is_unique": target}).drop("_source_unique", "_target_unique")


def dedupe_relationships(relationships: DataFrame) -> DataFrame:
    """The first relationship of each signature, and how many copies were removed.

    The first row is an aggregate, so copies combine before the shuffle.
    """
    rest = [c for c in relationships.columns if c not in SIGNATURE]
    first = F.min_by(F.struct(*rest), "rel_no")
    return (relationships.groupBy(*SIGNATURE)
            .agg(first.alias("_r"), (F.count("*") - 1).alias("n_removed"))
            .select(*SIGNATURE, "_r.*", "n_removed"))


def build_relationships(relationships: DataFrame, tables: DataFrame, columns: DataFrame,
                        constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships that can be drawn, each once, with their type; those skipped); validated once and written."""
    validated = written(validate_relationships(relationships, tables, columns), "validated")
    typed = relationship_type(validated.filter("skip_type IS NULL").drop("skip_type"),
                              unique_keys(columns, constraints))
    return dedupe_relationships(typed), validated.filter("skip_type IS NOT NULL")


def relationship_warnings(built: DataFrame, skipped: DataFrame) -> DataFrame:
    """Messages about composite, self-referencing, unusual, duplicate and skipped ones.

    Equal messages are one row with their number ``n``, so copies are counted, not repeated.
    """
    copies = F.col("n_removed") + 1
    pair = F.concat_ws(" -> ", "source_table", "target_table")

    def message(text: Column, n: Column) -> Column:
        return F.struct(text.alias("message"), n.cast("long").alias("n"))

    about_built = scale.rules(
        (F.size("source_columns") > 1, message(F.format_string("Composite relationship %s may cause parser issues", pair), copies)),
        (F.col("source_table") == F.col("target_table"),
         message(F.format_string("Self-referencing relationship on %s", "source_table"), copies)),
        (~F.col("target_is_unique"), message(F.format_string("Relationship %s references non-unique columns", pair), copies)),
        (F.col("n_removed") > 0, message(F.format_string("Duplicate relationship %s removed", pair), F.col("n_removed"))))
    about_skipped = message(F.format_string("Skipped relationship %s: %s", pair, "skip_type"), F.lit(1))
    rows = [built.select("schema_id", F.explode(about_built).alias("w")),
            skipped.select("schema_id", about_skipped.alias("w"))]
    return (reduce(DataFrame.unionByName, rows).select("schema_id", "w.*")
            .groupBy("schema_id", "message").agg(F.sum("n").alias("n")))


SKIPS = ["MISSING_SOURCE_TABLE", "MISSING_TARGET_TABLE", "MISSING_SOURCE_COLUMNS",
         "MISSING_TARGET_COLUMNS", "COLUMN_COUNT_MISMATCH"]


def has_cascade() -> Column:
    no = F.lit(False)
    return (F.coalesce(F.col("on_delete") == "CASCADE", no) | F.coalesce(F.col("on_update") == "CASCADE", no))


def relationship_report(built: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per schema: built and skipped ones, by kind."""
    return scale.tally(
        ["schema_id"],
        (built, {"n_built": scale.one(),
                 "n_one_to_one": F.col("relationship_type") == "one-to-one",
                 "n_many_to_one": F.col("relationship_type") == "many-to-one",
                 "n_composite": F.size("source_columns") > 1,
                 "n_self": F.col("source_table") == F.col("target_table"),
                 "n_cascade": has_cascade(), "n_duplicates": F.col("n_removed")}),
        (skipped, {"n_skipped": scale.one(), **{f"n_{s.lower()}": F.col("skip_type") == s for s in SKIPS}}))


def action_class(on_delete: Column, on_update: Column) -> Column:
    """cascade, restrict, set or other by the delete action; none without any action."""
    delete = F.lower(on_delete)
    return (F.when(F.coalesce(on_delete, F.lit("")).eqNullSafe("") & F.coalesce(on_update, F.lit("")).eqNullSafe(""), "none")
            .when(delete == "cascade", "cascade").when(delete == "restrict", "restrict")
            .when(delete.isin("set null", "set default"), "set").otherwise("other"))
