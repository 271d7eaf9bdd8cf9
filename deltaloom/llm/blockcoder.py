"""The block coder of id files as a function of the JVM, which codes one id at a time where numpy needs arrays of them.

``IdBlocks.java`` is compiled on the driver by the compiler that Spark brings for its own generated code, and sent to the
executors as a jar. It makes and reads the very blocks that idfile.py does.
"""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NAME = "deltaloom_id_block"
_SOURCE = Path(__file__).with_name("IdBlocks.java")


def _register(spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
    compiler.cook(_SOURCE.read_text(encoding="utf-8"))
    with tempfile.NamedTemporaryFile(prefix="deltaloom-", suffix=".jar", delete=False) as file:
        with zipfile.ZipFile(file, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
    path = Path(file.name).resolve()
    atexit.register(path.unlink, missing_ok=True)  # executors take it from the driver as long as the program runs
    spark.sparkContext._jsc.sc().addJar(str(path))
    udf = compiler.getClassLoader().loadClass("deltaloom.IdBlocks").getConstructor(None).newInstance(None)
    spark._jsparkSession.udf().register(_NAME, udf, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)


def _coded(spark: SparkSession, data: Column, vocabulary: Column, back: bool) -> Column:
    if not spark.catalog.functionExists(_NAME):
        _register(spark)
    return F.call_function(_NAME, data, vocabulary.cast("int"), F.lit(back))


def block_of(spark: SparkSession, ids: Column, vocabulary: Column) -> Column:
    """The block of ids, little-endian 32-bit integers below the vocabulary; null for null."""
    return _coded(spark, ids, vocabulary, False)


def ids_of(spark: SparkSession, block: Column, vocabulary: Column) -> Column:
    """The ids of a block, as block_of() takes them; a damaged one ends the query."""
    return _coded(spark, block, vocabulary, True)
