"""Queries: types."""

from pyspark.sql import functions as F

from attestor import fixed
from attestor.functions.names import type_components
from attestor.operators import types as ops
from attestor.plans.registry import query
from attestor.plans.sql_parts import MAPPED, TYPE_LOG, TYPE_WARNINGS, mapped, values

COLUMN = ["schema_id", "table_name", "ordinal", "column_name", "data_type"]


def mapped_columns(i, mapping=fixed.TYPE_MAP):
    c = i.views()
    return ops.map_types(c.columns, c.enums, mapping=mapping)


@query("typ_map", """
  SELECT schema_id, table_name, ordinal, column_name, data_type, new_type, type_rule FROM mapped""",
       mapped=MAPPED)
def typ_map(i):
    return mapped_columns(i).select(*COLUMN, "new_type", "type_rule")


@query("typ_split", """
  SELECT schema_id, table_name, ordinal, split_part(data_type, '(', 1) AS type_base,
    CASE WHEN data_type LIKE '%(%' THEN rtrim(split_part(data_type, '(', 2), ')') ELSE '' END AS type_parameters
  FROM f_columns""")
def typ_split(i):
    base, parameters = type_components(F.col("data_type"))
    return i.table("f_columns").select(
        "schema_id", "table_name", "ordinal", base.alias("type_base"),
        F.coalesce(parameters, F.lit("")).alias("type_parameters"))


@query("typ_enum", """
  SELECT c.schema_id, c.table_name, c.ordinal, c.data_type, e.enum_name IS NOT NULL AS is_enum
  FROM f_columns c LEFT JOIN f_enums e ON e.schema_id = c.schema_id AND e.enum_name = c.data_type""")
def typ_enum(i):
    c = i.views()
    return ops.keep_enums(c.columns, c.enums).select("schema_id", "table_name", "ordinal", "data_type", "is_enum")


@query("typ_array", """
  SELECT schema_id, table_name, ordinal, data_type,
    CASE data_type WHEN 'text[]' THEN '"text[]"' WHEN 'integer[]' THEN '"int4[]"' END AS native_type,
    'text' AS fallback_type
  FROM f_columns WHERE data_type LIKE '%[]%'""")
def typ_array(i):
    native = ops.map_arrays(i.views().columns).withColumnRenamed("new_type", "native_type")
    return (ops.map_arrays(native, "text_fallback").withColumnRenamed("new_type", "fallback_type")
            .select("schema_id", "table_name", "ordinal", "data_type", "native_type", "fallback_type"))


@query("typ_fallback", f"""
  SELECT schema_id, table_name, ordinal, data_type, 'text' AS new_type FROM f_columns
  WHERE data_type NOT LIKE '%[]%' AND split_part(data_type, '(', 1) NOT IN
    (SELECT k FROM {values(fixed.TYPE_MAP.items(), 'k, t')})""")
def typ_fallback(i):
    return ops.fallback(i.views().columns).select("schema_id", "table_name", "ordinal", "data_type", "new_type")


@query("typ_loss", "SELECT * FROM type_warnings", mapped=MAPPED, type_warnings=TYPE_WARNINGS)
def typ_loss(i):
    return ops.type_warnings(mapped_columns(i)).select("schema_id", "table_name", "column_name", "message")


@query("typ_log", "SELECT * FROM type_log", mapped=MAPPED, type_log=TYPE_LOG)
def typ_log(i):
    return ops.type_log(mapped_columns(i))


@query("typ_report", """
  SELECT schema_id, reason, coalesce(original_type, 'ALL') AS original_type, coalesce(new_type, 'ALL') AS new_type,
    count(*) AS n_columns FROM type_log
  GROUP BY GROUPING SETS ((schema_id, reason, original_type, new_type), (schema_id, reason))""",
       mapped=MAPPED, type_log=TYPE_LOG)
def typ_report(i):
    return ops.type_report(ops.type_log(mapped_columns(i)))


@query("typ_alt", "SELECT schema_id, table_name, ordinal, data_type, new_type FROM mapped",
       mapped=mapped(fixed.STRICT_TYPE_MAP))
def typ_alt(i):
    return mapped_columns(i, fixed.STRICT_TYPE_MAP).select(
        "schema_id", "table_name", "ordinal", "data_type", "new_type")


@query("typ_cast", """
  SELECT 'priority' AS column_name, 'int2' AS target_type, count(*) AS n_values,
    count(*) FILTER (try_cast(split_part(o_orderpriority, '-', 1) AS SMALLINT) IS NULL) AS n_failed FROM orders
  UNION ALL SELECT 'day', 'date', count(*), count(*) FILTER (o_orderkey % 7 = 0) FROM orders
  UNION ALL SELECT 'price', 'numeric(8,2)', count(*),
    count(*) FILTER (round(o_totalprice, 2) >= 1000000) FROM orders
  UNION ALL SELECT 'status', 'bool', count(*), count(*) FILTER (lower(o_orderstatus) NOT IN ('t', 'f', 'y', 'n')) FROM orders""")
def typ_cast(i):
    day = F.col("o_orderdate").cast("date").cast("string")
    texts = i.table("orders").select(
        F.substring_index("o_orderpriority", "-", 1).alias("priority"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("on "), day)).otherwise(day).alias("day"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderstatus").alias("status"))
    return ops.cast_failures(texts, {"priority": "int2", "day": "date", "price": "numeric(8,2)",
                                     "status": "bool"})
