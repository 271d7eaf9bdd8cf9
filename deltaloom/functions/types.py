"""Names of types that configurations may cast to."""

from __future__ import annotations

import logging

from pyspark.sql import types as T

# Type names of the configuration and the Spark types that hold their values.
CAST_TYPES: dict[str, T.DataType] = {
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Decimal": T.DecimalType(38, 10),
    "String": T.StringType(),
    "Utf8": T.StringType(),
    "Boolean": T.BooleanType(),
    "Date": T.DateType(),
    "Datetime": T.TimestampNTZType(),
    "Binary": T.BinaryType(),
    "Categorical": T.StringType(),
    "Enum": T.StringType(),
    "Duration": T.LongType(),  # of microseconds
}

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def cast_type(name: str | None) -> T.DataType | None:
    """The type of that name; an unknown name casts nothing."""
    if name is None:
        return None
    if name not in CAST_TYPES:
        logging.getLogger(__name__).warning("cast_to %r is unknown and has no effect", name)
    return CAST_TYPES.get(name)


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equal but for nullability inside nested types."""
    return a.simpleString() == b.simpleString()


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, INTEGERS)
