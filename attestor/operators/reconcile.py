"""What a converted copy lost compared with its source, and which losses no warning names.

Losses share one form: schema_id, type, severity, table_name, detail, lost_count,
description, impact. ``detail`` is the target table, the constraint kind or the column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import fixed, scale
from attestor.session import written
from attestor.sources.catalog import Catalog

TABLE = ["schema_id", "table_name"]
# ranges of key hashes: bits a level, rows of a range that is not cut any more, and most ranges sent to tasks
BRANCHES, LEAF, LISTED = 8, 64, 100_000
LOSS = ["schema_id", "type", "severity", "table_name", "detail", "lost_count", "description", "impact"]


def impact(kind: Column) -> Column:
    """What a loss of each type means for the one who reads the copy."""
    return F.create_map(*[F.lit(x) for pair in fixed.LOSS_IMPACTS.items() for x in pair])[kind]


def _losses(df: DataFrame, kind: str, severity: str | Column, description: Column,
            detail: Column | None = None, lost: Column | None = None) -> DataFrame:
    return df.select(
        "schema_id", F.lit(kind).alias("type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        "table_name", (F.lit("") if detail is None else detail).alias("detail"),
        (F.lit(1) if lost is None else lost).cast("long").alias("lost_count"),
        description.alias("description"), F.lit(fixed.LOSS_IMPACTS[kind]).alias("impact"))


def missing_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables of the source that the copy lacks."""
    gone = a.select(*TABLE).join(b.select(*TABLE), TABLE, "left_anti").distinct()
    return _losses(gone, "MISSING_TABLE", "CRITICAL",
                   F.format_string("Table '%s' is not in the copy", "table_name"))


def missing_relationships(a: DataFrame, b: DataFrame, by: str = "pair") -> DataFrame:
    """Relationships lost, compared by their pair of tables, or by tables and columns."""
    keys = ["schema_id", "source_table", "target_table"]
    if by == "columns":
        keys += ["source_columns", "target_columns"]
    named = a.filter("source_table <> '' AND target_table <> ''").select(*keys)
    gone = named.join(b.select(*keys), keys, "left_anti").distinct().withColumnRenamed("source_table", "table_name")
    return _losses(gone, "MISSING_RELATIONSHIP", "HIGH",
                   F.format_string("Relationship %s -> %s is not in the copy", "table_name", "target_table"),
                   detail=F.col("target_table"))


def missing_constraints(a: DataFrame, b: DataFrame, tables: DataFrame) -> DataFrame:
    """Per table and kind, how many constraints are fewer in the copy; only tables it kept.

    Both sides are counted in one grouping, so the counts need no join.
    """
    kinds = F.create_map(*[F.lit(x) for pair in fixed.CONSTRAINT_KINDS.items() for x in pair])

    def of_kind(df):
        return df.withColumn("kind", kinds[F.lower("constraint_type")]).filter("kind IS NOT NULL")

    counts = scale.tally([*TABLE, "kind"], (of_kind(a), {"_a": scale.one()}), (of_kind(b), {"_b": scale.one()}))
    fewer = counts.withColumn("lost", F.col("_a") - F.col("_b")).filter("lost > 0")
    kept = fewer.join(tables.select(*TABLE), TABLE, "left_semi")
    return _losses(kept, "MISSING_CONSTRAINT", F.when(F.col("kind") == "check", "HIGH").otherwise("MEDIUM"),
                   F.format_string("%d %s constraint(s) fewer on table '%s'",
                                   "lost", "kind", "table_name"),
                   detail=F.col("kind"), lost=F.col("lost"))


def hidden_cascades(relationships: DataFrame) -> DataFrame:
    """Cascade actions that the relationship's own definition text does not mention."""
    r = relationships
    if "definition" in r.columns:
        r = r.filter(~F.coalesce(F.contains(F.upper("definition"), F.lit("CASCADE")), F.lit(False)))
    actions = F.array_join(scale.rules((F.col("on_delete") == "CASCADE", F.lit("DELETE")),
                                       (F.col("on_update") == "CASCADE", F.lit("UPDATE"))), "/")
    r = r.withColumn("_actions", actions).filter("_actions <> ''").withColumnRenamed("source_table", "table_name")
    return _losses(r, "INVISIBLE_CASCADE", "MEDIUM",
                   F.format_string("CASCADE %s of %s -> %s does not show",
                                   "_actions", "table_name", "target_table"),
                   detail=F.col("target_table"))


def missing_columns(a: DataFrame, b: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns lost from the tables that the copy kept."""
    keys = [*TABLE, "column_name"]
    # what is lost is little, so copies of a name are left out only there
    gone = (a.select(*keys).join(b.select(*keys), keys, "left_anti")
            .join(tables.select(*TABLE), TABLE, "left_semi").distinct())
    return _losses(gone, "MISSING_COLUMN", "HIGH",
                   F.format_string("Column '%s.%s' is not in the copy",
                                   "table_name", "column_name"),
                   detail=F.col("column_name"))


_IS_KIND = "type = 'MISSING_CONSTRAINT'"
_IS_CASCADE = "type = 'INVISIBLE_CASCADE'"


def mentions(messages: DataFrame, names: DataFrame, whole_word: bool = False) -> DataFrame:
    """(schema_id, message_id, name): which messages contain which names of their schema.

    A dictionary by (anchor, length): the anchor of a name is its longest beginning whose length is
    a power of two, and behind each anchor stand the few lengths of the names that begin with it.
    The places of a message meet anchors by equality, without the text; the lengths behind them say
    which whole substrings to take, and these meet the names by equality. So however many names
    share a beginning, a message never meets one that it does not contain. An empty name stands in
    every message, and as a whole word in none.
    """
    messages = messages.select("schema_id", "message_id", "message")
    known = names.select("schema_id", "name").filter("name <> ''").distinct()
    anchor = F.expr("substring(name, 1, shiftleft(1, cast(floor(log2(length(name))) as int)))")
    heads = (known.select("schema_id", anchor.alias("_anchor"), F.length("name").alias("_length"))
             .groupBy("schema_id", "_anchor").agg(F.collect_set("_length").alias("_lengths")))
    sizes = heads.groupBy("schema_id").agg(F.collect_set(F.length("_anchor")).alias("_sizes"))
    places = F.flatten(F.transform(
        F.filter("_sizes", lambda n: n <= F.length("message")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("message") - n + 1),
                              lambda at: F.struct(at.alias("_at"), F.substring(F.col("message"), at, n).alias("_anchor")))))
    met = (messages.join(sizes, "schema_id").select("schema_id", "message_id", F.explode(places).alias("_p"))
           .select("schema_id", "message_id", "_p._at", "_p._anchor").join(heads, ["schema_id", "_anchor"])
           .groupBy("schema_id", "message_id").agg(F.collect_list(F.struct("_at", "_lengths")).alias("_met")))
    # a name stands whole where neither neighbour can belong to a name
    free = lambda at: ~F.rlike(F.substring(F.col("message"), at, F.lit(1)), F.lit(r"^[\p{L}\p{N}_]"))
    last = lambda at, n: at + n - 1 <= F.length("message")
    fits = (lambda at, n: last(at, n) & ((at == 1) | free(at - 1)) & free(at + n)) if whole_word else last
    found = F.array_distinct(F.flatten(F.transform("_met", lambda m: F.transform(
        F.filter(m["_lengths"], lambda n: fits(m["_at"], n)), lambda n: F.substring(F.col("message"), m["_at"], n)))))
    taken = messages.join(met, ["schema_id", "message_id"]).select("schema_id", "message_id", F.explode(found).alias("name"))
    matches = taken.join(known, ["schema_id", "name"]).select("schema_id", "message_id", "name")
    if whole_word:
        return matches
    empty = names.filter("name = ''").select("schema_id").distinct()
    return matches.unionByName(messages.join(empty, "schema_id", "left_semi").select("schema_id", "message_id", F.lit("").alias("name")))


def mark_documented(losses: DataFrame, warnings: DataFrame, whole_word: bool = False) -> DataFrame:
    """Mark the losses that a warning of the same schema names.

    A warning documents a loss if its message contains the table name and, where there is
    one, the other table, the column, or in upper case the constraint kind; with ``whole_word``
    names count only between characters that cannot belong to a name. Hidden cascades are never
    documented by a warning. Null names are never found.

    Losses and the matches of names in messages feed several branches, so each is computed once and
    written. A table and a detail are matched on the message, so losses are never compared with all
    messages, and there is one way for few and for many warnings.
    """
    messages = (warnings.filter("message IS NOT NULL").select("schema_id", "message").distinct()
                .withColumn("message_id", F.md5("message")))
    how = F.when(F.expr(_IS_KIND), "kind").when(F.col("detail") == "", "table").otherwise("name")
    if "impact" not in losses.columns:
        losses = losses.withColumn("impact", impact(F.col("type")))
    keyed = written(losses.select(*LOSS, how.alias("_how")), "losses")
    open_losses = keyed.filter(f"NOT {_IS_CASCADE}").select(*TABLE, "_how", "detail").distinct()
    named = F.explode(F.when(F.col("_how") == "name", F.array("table_name", "detail")).otherwise(F.array("table_name")))
    names = keyed.filter(f"NOT {_IS_CASCADE}").select("schema_id", named.alias("name")).distinct()
    found = written(mentions(messages, names, whole_word), "mentions")
    of_table = found.withColumnRenamed("name", "table_name")
    kinds = scale.rules(*[(F.contains(F.upper("message"), F.lit(k.upper())), F.lit(k))
                          for k in fixed.CONSTRAINT_KINDS.values()])
    of_detail = (found.select("schema_id", "message_id", F.lit("name").alias("_how"), F.col("name").alias("detail"))
                 .unionByName(messages.select("schema_id", "message_id", F.lit("kind").alias("_how"), F.explode(kinds).alias("detail"))))
    alone = (open_losses.filter("_how = 'table'").join(of_table, TABLE, "left_semi"))
    # a detail like a common column stands in many messages, a table in few: the table's messages come first
    paired = (open_losses.filter("_how <> 'table'").join(of_table, TABLE)
              .join(of_detail, ["schema_id", "message_id", "_how", "detail"], "left_semi").select(*open_losses.columns))
    documented = alone.unionByName(paired).distinct().withColumn("_found", F.lit(True))
    return (keyed.join(documented, [*TABLE, "_how", "detail"], "left")
            .select(*LOSS, (F.col("_found").isNotNull() & ~F.expr(_IS_CASCADE)).alias("is_documented")))


def silent_only(losses: DataFrame, warnings: DataFrame, whole_word: bool = False) -> DataFrame:
    """The losses that no warning names."""
    return mark_documented(losses, warnings, whole_word).filter("NOT is_documented").select(*LOSS)


def silent_failures(a: Catalog, b: Catalog, warnings: DataFrame) -> DataFrame:
    """All five kinds of loss, without those that are documented."""
    return silent_only(all_losses(a, b), warnings)


def all_losses(a: Catalog, b: Catalog) -> DataFrame:
    found = [missing_tables(a.tables, b.tables),
             missing_relationships(a.relationships, b.relationships),
             missing_constraints(a.constraints, b.constraints, b.tables),
             hidden_cascades(b.relationships),
             missing_columns(a.columns, b.columns, b.tables)]
    return reduce(DataFrame.unionByName, found)


def failure_report(failures: DataFrame) -> DataFrame:
    """Counts per schema: by type, by severity and in all; 'ALL' marks what is summed up."""
    return (failures.groupingSets(
        [["schema_id", "type"], ["schema_id", "severity"], ["schema_id"]], "schema_id", "type", "severity")
        .agg(F.count("*").alias("n_failures"),
             F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
             F.count_if(F.col("severity") == "HIGH").alias("n_high"),
             F.count_if(F.col("severity") == "MEDIUM").alias("n_medium"))
        .withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ["type", "severity"]}))


def reconcile_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows were lost, added or changed between two versions of a table.

    Both versions are stacked and grouped by key with hashes of the other columns, so the
    values themselves are not shuffled, and repeated keys combine before the shuffle.
    """
    rest = [c for c in a.columns if c not in keys]
    # the hash skips nulls, so each value goes in with a flag; two seeds give 128 bits
    flagged = [x for c in rest for x in (F.col(c), F.isnull(c))]
    hashes = {f"_h{seed}": F.xxhash64(F.lit(seed), *flagged) for seed in (1, 2)}

    def side(df, in_a: int):
        return df.select(*keys, *[h.alias(n) for n, h in hashes.items()], F.lit(in_a).alias("_a"), F.lit(1 - in_a).alias("_b"))

    sign = F.col("_a") - F.col("_b")
    compared = [x for n in hashes for x in (F.sum(F.col(n).bitwiseAND(0x7FFFFFFF) * sign).alias(f"{n}_sum"), F.bit_xor(n).alias(f"{n}_xor"))]
    grouped = side(a, 1).unionByName(side(b, 0)).groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"), *compared)
    differs = F.greatest(*[F.abs(F.sign(f"{n}_{x}")) for n in hashes for x in ("sum", "xor")]) != 0
    status = (F.when(F.col("_nb") == 0, "lost").when(F.col("_na") == 0, "added")
              .when((F.col("_na") != F.col("_nb")) | differs, "changed"))
    return (grouped.select(*keys, status.alias("status"), F.col("_na").alias("n_before"),
                           F.col("_nb").alias("n_after")).filter("status IS NOT NULL"))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions whose key lies in a range of key hashes where the versions differ.

    A digest tree: ranges are compared by order-free digests of all their rows, which are summed
    in each task, so a digest per range and task is all that is shuffled. Where two digests
    differ the range is cut into ``BRANCHES``, until ranges hold about ``LEAF`` rows; equal ranges
    are read again but never shuffled. The list of differing ranges goes to the tasks as long as it
    has at most ``LISTED`` entries; beyond that so much has changed that rows are compared at once.
    """
    rest = [c for c in a.columns if c not in keys]
    # nulls are skipped by the hash, so each value goes in with a flag
    flagged = [x for c in [*keys, *rest] for x in (F.col(c), F.isnull(c))]
    digest = [F.sum((F.xxhash64(F.lit(seed), *flagged).bitwiseAND(0xFFFFFFFF) * F.col("_sign")).cast("decimal(38,0)")).alias(f"_d{seed}") for seed in (1, 2)]
    place = F.xxhash64(*keys)
    bits, rows = 0, max(a.count(), b.count())
    while rows >> bits > LEAF:
        bits += BRANCHES
        span = F.shiftrightunsigned(place, 64 - bits)
        both = a.select(*[F.col(c) for c in a.columns], F.lit(1).alias("_sign")).unionByName(b.select(*a.columns, F.lit(-1).alias("_sign")))
        changed = written(both.groupBy(span.alias("_span")).agg(*digest).filter("_d1 <> 0 OR _d2 <> 0").select("_span"), "ranges")
        if changed.count() > LISTED:
            break
        a, b = (df.join(F.broadcast(changed), span == F.col("_span"), "left_semi") for df in (a, b))
    return a, b


def reconcile_ranges(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """As ``reconcile_rows``, for versions that are mostly alike: the shuffle grows with what has changed."""
    return reconcile_rows(*differing(a, b, keys), keys)


def reconcile_counts(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Groups that have fewer rows in the second version, and how many."""
    counts = scale.tally(group, (a, {"n_before": scale.one()}), (b, {"n_after": scale.one()}))
    return counts.withColumn("n_lost", F.col("n_before") - F.col("n_after")).filter("n_lost > 0")
