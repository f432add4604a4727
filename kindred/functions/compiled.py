"""Functions in Java for what is too slow by rows in Python and has no expression in Spark.

The source is compiled by Janino, which Spark brings along for its own generated code, and
given to the executors as a jar.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import BinaryType

from ..sources.storage import shared_root

_registered: set[tuple[str, str]] = set()


def register(spark: SparkSession, name: str) -> str:
    """Registers kindred.NAME of NAME.java beside this file as a function that gives bytes; its name in SQL."""
    function, own, jvm = f"kindred_{name.lower()}", (spark.sparkContext.applicationId, name), spark._jvm
    if own not in _registered:
        _ship(spark, name)
        _registered.add(own)
    if not spark.catalog.functionExists(function):
        made = jvm.java.lang.Class.forName(f"kindred.{name}", True, spark._jsparkSession.sharedState().jarClassLoader())
        kind = spark._jsparkSession.parseDataType(BinaryType().json())
        spark._jsparkSession.udf().register(function, made.getDeclaredConstructor(_none(spark, jvm.java.lang.Class)).newInstance(_none(spark, jvm.java.lang.Object)), kind)
    return function


def _none(spark: SparkSession, kind):
    return spark.sparkContext._gateway.new_array(kind, 0)


def _ship(spark: SparkSession, name: str) -> None:
    """Compiles a source and adds it as a jar, by the folder that all share, whatever store that is in."""
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as jar:
        for entry in compiler.getBytecodes().entrySet():
            jar.writestr(f"{entry.getKey().replace('.', '/')}.class", bytes(entry.getValue()))
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/kindred-{uuid.uuid4().hex}.jar")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sql(f"ADD JAR '{target.toString()}'")
