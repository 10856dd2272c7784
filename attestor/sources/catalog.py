"""The catalog: the record sets of many databases, one DataFrame each, keyed by schema_id."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attestor.session import scratch_folder

_S, _L, _B, _A = T.StringType(), T.LongType(), T.BooleanType(), T.ArrayType(T.StringType())


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SCHEMAS = {
    "tables": _struct(schema_id=_L, table_no=_L, table_name=_S, original_statement=_S),
    "columns": _struct(schema_id=_L, table_name=_S, ordinal=T.IntegerType(), column_name=_S,
                       data_type=_S, is_nullable=_B, default_value=_S, is_primary_key=_B,
                       is_unique=_B),
    "constraints": _struct(schema_id=_L, table_name=_S, constraint_name=_S, constraint_type=_S,
                           columns=_A, definition=_S),
    "relationships": _struct(schema_id=_L, rel_no=_L, source_table=_S, source_columns=_A,
                             target_table=_S, target_columns=_A, on_delete=_S, on_update=_S),
    "indexes": _struct(schema_id=_L, table_name=_S, index_name=_S, columns=_A, is_unique=_B,
                       index_method=_S, definition=_S),
    "enums": _struct(schema_id=_L, enum_name=_S, values=_A),
    "sequences": _struct(schema_id=_L, sequence_name=_S),
    "errors": _struct(schema_id=_L, error=_S, statement=_S, context=_S),
    "warnings": _struct(schema_id=_L, source=_S, message=_S),
}


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    relationships: DataFrame
    indexes: DataFrame
    enums: DataFrame
    sequences: DataFrame
    errors: DataFrame
    warnings: DataFrame


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> Catalog:
    """Read a catalog written as one folder per record set, with declared schemas."""
    return Catalog(**{f.name: spark.read.schema(SCHEMAS[f.name]).format(fmt).load(f"{path}/{f.name}")
                      for f in fields(Catalog)})


def write_catalog(catalog: Catalog, path: str, fmt: str = "parquet") -> None:
    """Write every record set range-sorted by schema, so that min/max statistics prune scans."""
    for name, schema in SCHEMAS.items():
        df = getattr(catalog, name).select(*schema.names)
        # the other columns split a schema that holds most of the rows over several files
        by = [n for n in schema.names if not isinstance(schema[n].dataType, T.ArrayType)]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.format(fmt).save(f"{path}/{name}")


# what the record sets are joined and counted by; the others are joined by schema alone or not at all
BUCKETED_BY = {"tables": ["schema_id", "table_name"], "columns": ["schema_id", "table_name"], "constraints": ["schema_id", "table_name"],
               "relationships": ["schema_id", "source_table"], "indexes": ["schema_id", "table_name"]}


class LazyCatalog(Catalog):
    """A catalog whose record sets are made when they are first asked for; a set that no query asks for is never made."""

    def __init__(self, make: Callable[[str], DataFrame] | None = None, **sets: DataFrame):
        self.__dict__.update(sets, _make=make)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS or self.__dict__.get("_make") is None:
            raise AttributeError(name)
        self.__dict__[name] = made = self._make(name)
        return made


ROWS_PER_BUCKET = 250_000


def buckets_for(rows: int) -> int:
    """The number of buckets for tables of so many rows: a bucket is one task's share, so it must not grow with them.

    A power of two, at least 16, so that tables of different sizes can still be joined bucket by bucket.
    """
    return max(16, 1 << max(0, math.ceil(rows / ROWS_PER_BUCKET) - 1).bit_length())


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The same rows, read back from a table in the scratch folder that is bucketed and sorted by the keys."""
    stored = f"catalog_{name}_{uuid.uuid4().hex}"
    # one file for each bucket: rows are brought to their bucket before they are written
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch_folder(df.sparkSession, f"catalog-{name}"))
     .saveAsTable(stored))
    return df.sparkSession.table(stored)


def store_catalog(catalog: Catalog, buckets: int | None = None) -> Catalog:
    """The catalog as tables bucketed and sorted by schema and table, so that joins and counts by these need no shuffle.

    Each record set is written when it is first asked for. All have the same number of buckets, which
    follows from the number of columns unless it is given; a schema with most of the tables is spread
    over all of them, as the name of the table counts too. Files go to the scratch folder.
    """
    number: list[int] = [] if buckets is None else [buckets]

    def make(name: str) -> DataFrame:
        df, keys = getattr(catalog, name), BUCKETED_BY.get(name)
        if not keys:
            return df
        if not number:
            number.append(buckets_for(catalog.columns.count()))
        return bucketed(df, name, keys, number[0])

    return LazyCatalog(make)
