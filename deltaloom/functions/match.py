"""The predicate that decides whether two values of a column match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.errors import ConfigError
from deltaloom.functions.normalize import replace_all
from deltaloom.functions.types import is_integer, same_type
from deltaloom.spec import ColumnRule

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_EDGES = {"left": (r"(?U)^\s+",), "right": (r"(?U)\s+\z",), "both": (r"(?U)^\s+", r"(?U)\s+\z"), "none": ()}


def clean_text(c: Column, rule: ColumnRule) -> Column:
    c = replace_all(c, rule.regex_replace or {})
    for edge in _EDGES[rule.whitespace]:
        c = F.regexp_replace(c, F.lit(edge), F.lit(""))
    return F.lower(c) if rule.case_insensitive else c


def translate_values(c: Column, dtype: T.DataType, mapping: dict[str, str]) -> Column:
    """One simultaneous lookup; values without an entry stay."""
    if not mapping:
        return c
    out = None
    for old, new in mapping.items():
        hit = c == F.lit(old).try_cast(dtype)
        out = F.when(hit, F.lit(new).try_cast(dtype)) if out is None else out.when(hit, F.lit(new).try_cast(dtype))
    return out.otherwise(c)


def within_tolerance(source: Column, target: Column, dtype: T.DataType, rule: ColumnRule) -> Column:
    if is_integer(dtype):
        source, target = source.cast("bigint"), target.cast("bigint")
        gap = F.try_subtract(target, source).cast("double")
        size = F.abs(source.cast("double"))
    else:
        gap, size = target - source, F.abs(source)
    return F.abs(gap) <= F.lit(rule.abs_tol) + F.lit(rule.rel_tol) * size


def comparable(c: Column, dtype: T.DataType) -> Column:
    """Maps have no equality; their sorted entries do."""
    return F.array_sort(F.map_entries(c)) if isinstance(dtype, T.MapType) else c


def matches(source: Column, target: Column, source_type: T.DataType, target_type: T.DataType, rule: ColumnRule, strict: bool) -> Column:
    """True or false, never null."""
    both_null = source.isNull() & target.isNull()
    if not same_type(source_type, target_type):
        if strict:
            return both_null if rule.treat_null else F.lit(False)
        target = target.try_cast(source_type)
    source = translate_values(source, source_type, rule.value_map or {})
    if isinstance(source_type, T.StringType):
        source, target = clean_text(source, rule), clean_text(target, rule)
        equal = source == target
    elif isinstance(source_type, T.NumericType) and (rule.abs_tol or rule.rel_tol):
        equal = within_tolerance(source, target, source_type, rule)
    else:
        equal = comparable(source, source_type) == comparable(target, source_type)
    equal = F.coalesce(equal, F.lit(False))
    return equal | (source.isNull() & target.isNull()) if rule.treat_null else equal


def check_value_map(name: str, dtype: T.DataType, mapping: dict[str, str]) -> None:
    """Rejects entries that are no values of the column's type, as they would silently become null."""
    if not mapping or isinstance(dtype, T.StringType):
        return
    if not isinstance(dtype, T.NumericType):
        raise ConfigError(f"value_map of {name} needs a string or numeric column, not {dtype.simpleString()}")
    for text in (*mapping, *mapping.values()):
        if not _is_value(text.strip(), dtype):
            raise ConfigError(f"value_map of {name}: {text!r} is no {dtype.simpleString()}")


def _is_value(text: str, dtype: T.DataType) -> bool:
    if is_integer(dtype):
        bits = _BITS[type(dtype)] - 1
        return re.fullmatch(r"[+-]?[0-9]+", text) is not None and -(1 << bits) <= int(text) < 1 << bits
    try:
        float(text)
    except ValueError:
        return False
    if not isinstance(dtype, T.DecimalType):
        return True
    # Rounding would make it another value.
    number = re.fullmatch(r"[+-]?([0-9]*)\.?([0-9]*)", text)
    return number is not None and len(number[1].lstrip("0")) <= dtype.precision - dtype.scale and len(number[2].rstrip("0")) <= dtype.scale
