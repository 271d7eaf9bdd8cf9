"""Rewrites that happen to both sides, keys included, before rows are matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions.dialect import java_pattern, java_replacement
from deltaloom.functions.types import cast_type
from deltaloom.spec import ColumnRule


def replace_all(c: Column, replacements: dict[str, str]) -> Column:
    for pattern, replacement in replacements.items():
        c = F.regexp_replace(c, F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement)))
    return c


def hard_cast(c: Column, to: T.DataType, name: str) -> Column:
    """A cast that fails the job on a value that doesn't fit, whatever the session's ANSI setting."""
    done = c.try_cast(to)
    problem = F.raise_error(F.concat(F.lit(f"column {name}: cannot cast to {to.simpleString()}: "), c.cast("string")))
    return F.when(c.isNotNull() & done.isNull(), problem.cast(to)).otherwise(done)


def normalize(c: Column, dtype: T.DataType, rule: ColumnRule, name: str) -> tuple[Column, T.DataType]:
    """Null markers, then replacements, then the cast; the first two only touch strings."""
    if isinstance(dtype, T.StringType):
        if rule.null_values:
            c = F.when(c.isin(*rule.null_values), F.lit(None).cast(dtype)).otherwise(c)
        c = replace_all(c, rule.regex_replace or {})
    to = cast_type(rule.cast_to)
    if to is not None and not isinstance(dtype, type(to)):
        c, dtype = hard_cast(c, to, name), to
    return c, dtype
