"""Type mapping of catalog columns, and its log, warnings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor import fixed, scale
from attestor.functions import names

COLUMN = ["schema_id", "table_name", "column_name"]


def keep_enums(columns: DataFrame, enums: DataFrame) -> DataFrame:
    """Mark columns whose type is an enum of the same schema.

    Spark broadcasts the enums when they are small; otherwise a schema that holds most of
    the columns is split at run time, as the columns are the preserved side.
    """
    base, _ = names.type_components(F.col("data_type"))
    declared = enums.select("schema_id", F.lower("enum_name").alias("_enum")).distinct()
    return (columns.withColumn("_enum", F.lower(base))
            .join(declared.withColumn("_declared", F.lit(True)), ["schema_id", "_enum"], "left")
            .withColumn("is_enum", F.col("_declared").isNotNull()).drop("_enum", "_declared"))


def lookup_types(columns: DataFrame, mapping: dict[str, str] = fixed.TYPE_MAP) -> DataFrame:
    """Join each type, or array element, with its target, null where there is none."""
    t = F.col("data_type")
    base, parameters = names.type_components(t)
    known = scale.dimension(columns, list(mapping.items()), ["_key", "target"])
    key = F.when(names.is_array(t), names.without_brackets(t)).otherwise(base)
    return (columns.withColumns({"type_base": base, "type_parameters": parameters,
                                 "is_array": names.is_array(t), "_key": F.lower(key)})
            .join(known, "_key", "left").drop("_key"))


def _array_type(strategy: str):
    if strategy == "text_fallback":
        return F.lit("text")
    element = F.coalesce("target", names.without_brackets(F.col("data_type")))
    return F.concat(F.lit('"'), element, F.lit('[]"'))


def _scalar_type():
    with_parameters = F.concat("target", F.lit("("), "type_parameters", F.lit(")"))
    keeps = F.col("target").isin(fixed.PARAMETER_TARGETS) & F.col("type_parameters").isNotNull()
    return F.when(keeps, with_parameters).otherwise(F.col("target"))


def map_types(columns: DataFrame, enums: DataFrame | None = None, strategy: str = "native",
              mapping: dict[str, str] = fixed.TYPE_MAP) -> DataFrame:
    """Give every column its new type and the rule that chose it.

    The rules are tried in this order: declared enum, array, known type, fallback to text.
    """
    marked = keep_enums(columns, enums) if enums is not None else columns.withColumn("is_enum", F.lit(False))
    rule = (F.when(F.col("is_enum"), "enum").when(F.col("is_array"), "array")
            .when(F.col("target").isNotNull(), "known").otherwise("fallback"))
    new_type = (F.when(F.col("is_enum"), F.col("type_base"))
                .when(F.col("is_array"), _array_type(strategy))
                .otherwise(F.coalesce(_scalar_type(), F.lit("text"))))
    return (lookup_types(marked, mapping).withColumns({"type_rule": rule, "new_type": new_type})
            .drop("target", "is_enum"))


def map_arrays(columns: DataFrame, strategy: str = "native",
               mapping: dict[str, str] = fixed.TYPE_MAP) -> DataFrame:
    """Only the array columns, with their new type."""
    arrays = columns.filter(names.is_array(F.col("data_type")))
    return lookup_types(arrays, mapping).withColumn("new_type", _array_type(strategy)).drop("target")


def fallback(columns: DataFrame, mapping: dict[str, str] = fixed.TYPE_MAP) -> DataFrame:
    """The columns without an entry in the mapping; they become text."""
    plain = columns.filter(~names.is_array(F.col("data_type")))
    return (lookup_types(plain, mapping).filter(F.col("target").isNull())
            .withColumn("new_type", F.lit("text")).drop("target"))


def type_warnings(mapped: DataFrame, strategy: str = "native") -> DataFrame:
    """A message for each column whose type loses its meaning."""
    lost = scale.dimension(mapped, list(fixed.LOSSY_TYPES.items()), ["_lossy", "loss"])
    t = F.col("data_type")
    flattened = F.lit(strategy == "text_fallback") & (F.col("type_rule") == "array")
    message = (
        F.when(F.col("type_rule") == "fallback", F.format_string("Unknown type '%s' converted to 'text'", t))
        .when(flattened, F.format_string("Array type '%s' flattened to text - array semantics lost", t))
        .when((F.col("type_rule") == "known") & F.col("loss").isNotNull(),
              F.format_string("Type '%s' converted to 'text' - %s types lose meaning", t, "loss")))
    return (mapped.withColumn("_lossy", F.lower("type_base")).join(lost, "_lossy", "left")
            .withColumn("message", message).filter(F.col("message").isNotNull())
            .select(*COLUMN, "data_type", F.lit("type").alias("source"), "message"))


def type_log(mapped: DataFrame) -> DataFrame:
    """The columns whose type changed, with the reason."""
    old = F.col("data_type")
    reason = (F.when(names.is_array(old), fixed.ARRAY_REASON)
              .when(F.lower(old).isin(fixed.SPECIFIC_TYPES), fixed.SPECIFIC_REASON)
              .when(F.contains(old, F.lit("with time zone")) | F.contains(old, F.lit("without time zone")),
                    fixed.MULTI_WORD_REASON)
              .otherwise(fixed.OTHER_REASON))
    return (mapped.filter(old != F.col("new_type"))
            .select(*COLUMN, old.alias("original_type"), "new_type", reason.alias("reason")))


def type_report(log: DataFrame) -> DataFrame:
    """Counts per schema and reason: by pair of types, and in all ('ALL'); the log is the list."""
    keys = ["schema_id", "reason"]
    return (log.groupingSets([[*keys, "original_type", "new_type"], keys], *keys, "original_type", "new_type")
            .agg(F.count("*").alias("n_columns"))
            .withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ["original_type", "new_type"]}))


_CASTS = {
    "int2": T.ShortType(), "smallint": T.ShortType(), "smallserial": T.ShortType(),
    "int4": T.IntegerType(), "integer": T.IntegerType(), "int": T.IntegerType(),
    "serial": T.IntegerType(),
    "int8": T.LongType(), "bigint": T.LongType(), "bigserial": T.LongType(),
    "float4": T.FloatType(), "real": T.FloatType(),
    "float8": T.DoubleType(), "double": T.DoubleType(), "float": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "interval": T.DayTimeIntervalType(), "bytea": T.BinaryType(),
    "json": T.VariantType(), "jsonb": T.VariantType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type that holds values of a named type."""
    bare = name.strip().lower()
    if bare.endswith("[]"):
        return T.ArrayType(spark_type(bare[:-2]))
    base, _, rest = bare.partition("(")
    if base in ("numeric", "decimal", "money"):
        numbers = [int(x) for x in rest.rstrip(")").split(",")] if rest else [38, 2]
        return T.DecimalType(*numbers)
    return _CASTS.get(base, T.StringType())


def cast_value(column: str, type_name: str):
    """A text column read as a named type, null where it does not fit."""
    target = spark_type(type_name)
    if isinstance(target, T.VariantType):
        return F.try_parse_json(F.col(column))
    return F.col(column).try_cast(target)


def cast_failures(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """For each column and target type: values present, and values that do not fit; one pass."""
    counts = []
    for column, type_name in targets.items():
        present = F.col(column).isNotNull()
        counts.append(F.struct(
            F.lit(column).alias("column_name"), F.lit(type_name).alias("target_type"),
            F.count_if(present).alias("n_values"),
            F.count_if(present & cast_value(column, type_name).isNull()).alias("n_failed")))
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
