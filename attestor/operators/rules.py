"""Declared rules, checked on the rows of data tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from attestor import scale
from attestor.session import written


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column, counted in one pass."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"),
                       F.count_if(F.col(c).isNull()).alias("n_nulls")) for c in columns]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of surplus rows."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
            .withColumn("n_surplus", F.col("n_rows") - 1))


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows without a parent; ``on`` maps child columns to parent columns.

    A null in the key satisfies the rule, so such rows are left out first. The child is the
    preserved side, so a key that holds most of its rows is split at run time.
    """
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    return child.filter(present).join(keys, list(on), "left_anti")


def _broken(rules: dict[str, Column]) -> dict[str, Column]:
    return {name: F.coalesce(~rule, F.lit(False)) for name, rule in rules.items()}


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule, in one pass; a rule that gives null is met."""
    counts = [F.struct(F.lit(name).alias("rule"), F.count("*").alias("n_rows"),
                       F.count_if(broken).alias("n_violations"))
              for name, broken in _broken(rules).items()]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, with the names of the broken ones."""
    broken = scale.rules(*[(condition, F.lit(name)) for name, condition in _broken(rules).items()])
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def domain_violations(df: DataFrame, column: str, values: list[str] | DataFrame) -> DataFrame:
    """Values outside the declared list, with their numbers of rows.

    Values are counted first, so only distinct ones are compared with a list from a table.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n_rows"))
    if isinstance(values, DataFrame):
        return counts.join(values.select(F.col(values.columns[0]).alias("value")), "value", "left_anti")
    return counts.filter(~F.col("value").isin(values))


def overlaps(df: DataFrame, key: str, start: str, end: str, tie: str, block: str = "HOUR") -> DataFrame:
    """Rows whose interval overlaps an earlier one of the same key.

    A row overlaps if the latest end among the rows before it, by start and ``tie``, lies
    after its start. The latest end is carried over blocks of time, so that a task sorts one
    block of a key and never a whole key; choose ``block`` as a unit of ``date_trunc`` that
    keeps a block of the busiest key in a task.
    """
    rows = df.withColumn("_block", F.date_trunc(block, start))
    by_block = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.groupBy(key, "_block").agg(F.max(end).alias("_end"))
               .select(key, "_block", F.max("_end").over(by_block).alias("_carry")))
    inside = (Window.partitionBy(key, "_block").orderBy(start, tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    latest = F.greatest("_carry", F.max(end).over(inside))
    return (rows.join(carried, [key, "_block"]).withColumn("latest_end", latest)
            .filter(F.col("latest_end") > F.col(start)).drop("_block", "_carry"))


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Replace nulls by the declared defaults; ``n_filled`` counts them in each row."""
    filled = sum(F.col(c).isNull().cast("int") for c in defaults)
    return df.withColumn("n_filled", filled).withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def cascade_reach(seed: DataFrame, chain: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows that deleting the seed takes along, per level.

    ``seed`` has the deleted keys in its only column. Each level is (name, rows, column that
    refers to the level above, own key). The chain is as long as it is declared.
    """
    level_keys, counts = seed, []
    for position, (name, rows, reference, key) in enumerate(chain, 1):
        taken = rows.join(level_keys.toDF(reference), reference, "left_semi")
        counts.append(taken.agg(F.count("*").alias("n_rows")).select(
            F.lit(position).alias("level"), F.lit(name).alias("table_name"), "n_rows"))
        level_keys = taken.select(key)
    return reduce(DataFrame.unionByName, counts)


def cascade_closure(seed: DataFrame, references: DataFrame) -> DataFrame:
    """(key, level): all rows that deleting the seed takes along through a table that refers to itself.

    ``seed`` has the deleted keys in its only column and is level 0; ``references`` is
    (parent, child). A row counts once, on the first level that reaches it, so circles end. Each
    step follows only the rows that the step before has newly reached and writes its result; the
    depth need not be known, the step that finds nothing is the last.
    """
    steps = [written(seed.toDF("key").filter("key IS NOT NULL").distinct(), "reached")]
    while True:
        reached = reduce(DataFrame.unionByName, steps)
        found = (references.join(steps[-1].toDF("parent"), "parent", "left_semi").select(F.col("child").alias("key"))
                 .filter("key IS NOT NULL").distinct().join(reached, "key", "left_anti"))
        seen = Observation()
        step = written(found.observe(seen, F.count("*").alias("n")), "reached")
        if not seen.get["n"]:
            return reduce(DataFrame.unionByName, [s.withColumn("level", F.lit(n)) for n, s in enumerate(steps)])
        steps.append(step)


def measured_cardinality(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """How many children parents really have: the most, and the share of parents with any.

    Children and parents are counted per key in one grouping; nothing is joined.
    """
    reference, key = on
    per_key = scale.tally(
        ["_key"], (child.select(F.col(reference).alias("_key")), {"_children": scale.one()}),
        (parent.select(F.col(key).alias("_key")), {"_parents": scale.one()})).filter("_parents > 0")
    most = F.coalesce(F.max("_children"), F.lit(0))
    return per_key.agg(
        most.alias("most_children"), F.count("*").alias("n_parents"),
        F.count_if(F.col("_children") > 0).alias("n_used")).select(
        "most_children", "n_parents", "n_used",
        F.coalesce(F.try_divide("n_used", "n_parents"), F.lit(0.0)).alias("used_share"),
        F.when(F.col("most_children") > 1, "many-to-one").otherwise("one-to-one").alias("cardinality"))
