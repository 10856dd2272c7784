"""Column functions on identifiers and type names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
PLAIN_NAME = "^[a-zA-Z_][a-zA-Z0-9_]*\\z"


def strip(c: Column) -> Column:
    """Cut white space of all kinds at both ends."""
    return F.trim(c, F.lit(BLANKS))


def strip_held(c: Column) -> Column:
    """As ``strip``, for a column at hand: only a text with white space at its end is walked through to find where it ends."""
    blank = reduce(Column.__or__, [F.endswith(c, F.lit(b)) for b in BLANKS])
    return F.when(blank, strip(c)).otherwise(F.ltrim(c, F.lit(BLANKS)))


def is_array(data_type: Column) -> Column:
    return F.contains(data_type, F.lit("[]"))


def without_brackets(data_type: Column) -> Column:
    return strip(F.replace(data_type, F.lit("[]"), F.lit("")))


def base_type(data_type: Column) -> Column:
    """The type without array brackets and parameters."""
    return strip(F.substring_index(without_brackets(data_type), "(", 1))


def type_parameters(data_type: Column) -> Column:
    """What stands between the parentheses, or null."""
    inside = F.regexp_extract(data_type, r"\(([^)]*)\)", 1)
    # most types have no parentheses and meet no pattern
    return F.when(F.contains(data_type, F.lit("(")), F.when(data_type.rlike(r"\([^)]*\)"), inside))


def type_components(data_type: Column) -> tuple[Column, Column]:
    """(base type with its brackets, parameters or null); a type whose head is no plain name is a base as it stands."""
    bare = without_brackets(data_type)
    head, parameters = base_type(data_type), F.nullif(type_parameters(bare), F.lit(""))
    parted = parameters.isNotNull() & head.rlike(PLAIN_NAME)
    base = F.when(parted, head).otherwise(bare)
    return F.concat(base, F.when(is_array(data_type), F.lit("[]")).otherwise(F.lit(""))), F.when(parted, parameters)


def listed(values) -> Column:
    """An array as one text."""
    return F.array_join(values, ",")
