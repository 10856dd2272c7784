"""What the operators share: settings, written tables, Arrow maps and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestor.session import configure, written

ARROW_ROWS = 512
BROADCAST_ROWS = 100_000

# fixed value: the characters \x20 and \x09-\x0D, between which words stand
BLANKS = " \t\n\x0b\x0c\r"


def prepared(spark: SparkSession) -> SparkSession:
    """Run-time settings, and Arrow batches of few rows, as single texts may be very long.

    Python workers are told where this package lies on the driver, which serves local sessions;
    on a cluster without that path, ship the package with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    configure(spark)
    # nothing here is stored in buckets; keys that hold a third of the rows want all join keys in the hash
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, as ``doc_id`` and ``text``, whatever else the input holds."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def mapped(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Stream the rows of each partition, as tuples, through ``work``, which yields tuples."""
    out = arrow(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                yield from zip(*[c.to_pylist() for c in part.columns])
        held = []
        for row in work(rows()):
            held.append(row)
            if len(held) == ARROW_ROWS:
                yield batch(out, held)
                held = []
        if held:
            yield batch(out, held)

    return df.mapInArrow(batches, schema)


def per_row(df: DataFrame, work: Callable[..., tuple], schema: str) -> DataFrame:
    """One output row for each input row."""
    return mapped(df, lambda rows: (work(*row) for row in rows), schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of few numbers if it has at most ``rows`` rows, else leave it to a shuffle.

    A row is some ten numbers at most, so what is broadcast stays below 10 MB.
    """
    return F.broadcast(df) if df.count() <= rows else df


def free_name(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, lineage cut."""
    return written(df, f"llm-{purpose}")
