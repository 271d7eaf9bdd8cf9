"""Readers by format."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.errors import ConfigError
from deltaloom.spec import SourceConfig

#: A value no file holds, so that an empty quoted field is the empty string and only an empty field is null.
_NO_NULL = "\u0001NULL"

# Reader options of configuration files and Spark's names for them.
_CSV_OPTIONS = {
    "separator": "sep",
    "has_header": "header",
    "null_values": "nullValue",
    "quote_char": "quote",
    "comment_prefix": "comment",
    "encoding": "encoding",
}
_SPARK_CSV_OPTIONS = {
    "sep", "header", "nullValue", "quote", "comment", "escape", "multiLine", "mode", "inferSchema", "samplingRatio",
    "dateFormat", "timestampFormat", "lineSep", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "emptyValue", "locale", "maxColumns",
}


def read_csv(spark: SparkSession, path: str, options: dict[str, Any]) -> DataFrame:
    """Integers as bigint; dates stay text unless ``try_parse_dates``; quoted empty fields are empty strings.

    Infers once, from all rows, corrects the schema, and reads again with it, failing on cells that don't fit. Quoted
    line breaks are read by default, so each file is one task; ``multiLine: false`` lets Spark split large files, if
    their fields have no line breaks. With several null markers all columns are read as text, and cast.
    """
    options = dict(options)
    parse_dates = bool(options.pop("try_parse_dates", False))
    options.pop("infer_schema_length", None)  # inference reads everything, so that no later cell can fail to fit
    settings: dict[str, Any] = {"header": True, "escape": '"', "multiLine": True, "nullValue": _NO_NULL, "mode": "FAILFAST"}
    markers: list[str] = []
    for name, value in options.items():
        if name == "null_values" and isinstance(value, list):
            markers = [str(v) for v in value]
        elif name in _CSV_OPTIONS:
            settings[_CSV_OPTIONS[name]] = value
        elif name in _SPARK_CSV_OPTIONS:
            settings[name] = value
        else:
            raise ConfigError(f"Unknown CSV option {name!r}")
    if len(markers) == 1:
        settings["nullValue"] = markers[0]
    elif markers:
        return _with_markers(spark.read.options(**settings).csv(path), markers)
    inferred = spark.read.options(**settings, inferSchema=True).csv(path).schema
    schema = T.StructType([T.StructField(f.name, _corrected(f.dataType, parse_dates), True) for f in inferred])
    return spark.read.options(**settings).schema(schema).csv(path)


def _with_markers(raw: DataFrame, markers: list[str]) -> DataFrame:
    """Text columns with each marker as null, cast to the first of bigint, double and boolean that fits all values."""
    names = raw.columns
    plain = raw.toDF(*[f"c{k}" for k in range(len(names))])
    plain = plain.select(*[F.when(~F.col(c).isin(markers), F.col(c)).alias(c) for c in plain.columns])
    fits = {"bigint": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "boolean": r"^(?i:true|false)$"}
    tests = [(c, kind, F.count(c) == F.count_if(F.col(c).rlike(pattern) & F.col(c).try_cast(kind).isNotNull())) for c in plain.columns for kind, pattern in fits.items()]
    row = plain.agg(*[test.alias(f"{c}_{kind}") for c, kind, test in tests], *[F.count(c).alias(c) for c in plain.columns]).collect()[0] if names else {}
    kinds = {c: next((kind for kind in fits if row[c] and row[f"{c}_{kind}"]), "string") for c in plain.columns}
    return plain.select(*[F.col(c).cast(kind) for c, kind in kinds.items()]).toDF(*names)


def _corrected(inferred: T.DataType, parse_dates: bool) -> T.DataType:
    if isinstance(inferred, T.IntegerType):
        return T.LongType()
    if isinstance(inferred, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return inferred if parse_dates else T.StringType()
    if isinstance(inferred, (T.DecimalType, T.NullType)):
        return T.StringType()
    return inferred


def read_parquet(spark: SparkSession, path: str, options: dict[str, Any]) -> DataFrame:
    return spark.read.options(**options).parquet(path)


READERS: dict[str, Callable[[SparkSession, str, dict[str, Any]], DataFrame]] = {"csv": read_csv, "parquet": read_parquet}


def reader_for(kind: str) -> Callable[[SparkSession, str, dict[str, Any]], DataFrame]:
    if kind not in READERS:
        raise NotImplementedError(f"No reader for {kind!r}: {' and '.join(READERS)} can be read")
    return READERS[kind]


def read(spark: SparkSession, source: SourceConfig) -> DataFrame:
    return reader_for(source.format)(spark, source.path, source.options)
