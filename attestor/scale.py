"""Building blocks that keep work spread out when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor import fixed

BLOCK = 1 << 20
WIDE_TALLY = 12


def dimension(df: DataFrame, rows: Sequence[tuple], names: list[str]) -> DataFrame:
    """A constant table, broadcast: its size is fixed in the code."""
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})"))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, width: int = BLOCK) -> DataFrame:
    """Number the rows of each key from 1 by an integer column that is unique per key.

    A window over a whole key would sort it in one task. Here the rows are numbered inside
    blocks of ``width`` order values, and each block starts at the sum of the earlier block
    counts, so a task never holds more than ``width`` rows of one key.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
              .select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (blocks.join(starts, [*keys, "_block"])
            .withColumn(name, F.col("_start") + F.row_number().over(inside))
            .drop("_block", "_start"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = BLOCK) -> DataFrame:
    """The sum of a value over the earlier rows of a key, by an integer column; blocks as in ``numbered``."""
    blocks = df.withColumn("_block", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_n"))
              .select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.join(starts, [*keys, "_block"])
            .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_block", "_before"))


def previous(df: DataFrame, keys: list[str], order: str, value: str, name: str,
             width: int = BLOCK) -> DataFrame:
    """The value of the row before, per key, by an integer column; blocks as in ``numbered``."""
    blocks = df.withColumn("_block", F.floor(F.col(order) / width))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    carried = (blocks.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
               .select(*keys, "_block", F.lag("_last").over(by_block).alias("_carry")))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    # only the first row of a block looks into the block before; a null before any other row is its value
    return (blocks.join(carried, [*keys, "_block"])
            .withColumn(name, F.when(F.row_number().over(inside) == 1, F.col("_carry")).otherwise(F.lag(value).over(inside)))
            .drop("_block", "_carry"))


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column], n: int,
               name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key with their number.

    The rank is the only window here, so Spark limits each key in every input task before
    the shuffle, and at most ``n`` rows per task and key travel.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def first_rows_and_total(df: DataFrame, keys: list[str], order: list[str | Column],
                         n: int) -> DataFrame:
    """The first ``n`` rows of each key, the key's row count and how many more there are."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("n_total"))
    return (first_rows(df, keys, order, n).join(totals, keys)
            .withColumn("n_more", F.greatest(F.col("n_total") - n, F.lit(0))))


def assemble(pieces: DataFrame, keys: list[str], order: list[str], text: str, separator: str) -> DataFrame:
    """Join the pieces of each key in order into one text; the input is read once.

    Meant for keys that stand for a unit of bounded size: a table, a statement, or one of the
    parts into which ``parts`` cuts something larger.
    """
    sorted_pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    size = F.octet_length(text) + len(separator.encode())
    return pieces.groupBy(*keys).agg(
        F.count("*").alias("n_pieces"), (F.sum(size) - len(separator.encode())).alias("n_bytes"),
        F.array_join(F.transform(sorted_pieces, lambda x: x["_text"]), separator).alias(text))


def parts(pieces: DataFrame, keys: list[str], order: str, text: str, separator: str,
          per_part: int = fixed.LINES_PER_PART) -> DataFrame:
    """The pieces of each key as texts of ``per_part`` pieces, numbered from 0; nothing is left out.

    No task holds more than a part, however many pieces a key has.
    """
    placed = (numbered(pieces, keys, order, "_n")
              .withColumn("part_no", F.floor((F.col("_n") - 1) / per_part).cast("int")))
    return assemble(placed, [*keys, "part_no"], [order], text, separator)


def rules(*cases: tuple[Column, Column]) -> Column:
    """The values whose condition holds, as an array: many rules in one pass over the rows."""
    return F.array_compact(F.array(*[F.when(condition, value) for condition, value in cases]))


def tally(keys: list[str], *parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Sum several counts over several inputs in one grouping.

    Each part gives a DataFrame and the numbers or conditions to add up from its rows. All
    parts are stacked and grouped once: sums combine before the only shuffle, and no count
    has to be joined to another. With many counts the generated grouping code becomes too
    large to be compiled by the JVM, so each part is summed by itself first and the stack
    holds one row per key and part.
    """
    names = list(dict.fromkeys(n for _, counts in parts for n in counts))
    wide = len(names) > WIDE_TALLY
    stacked = None
    for df, counts in parts:
        piece = df.select(*keys, *[c.cast("long").alias(n) for n, c in counts.items()])
        if wide:
            piece = piece.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counts]) if counts else piece.distinct()
        # what a part does not count is null there, and sums skip nulls
        stacked = piece if stacked is None else stacked.unionByName(piece, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def one() -> Column:
    return F.lit(1)
