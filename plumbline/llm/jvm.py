"""Java beside a module, built by the compiler that Spark has for its own expressions, and run in Spark's tasks.

Loops over single bits take less CPU there than passes over arrays in numpy, and nothing has to be installed. The driver
builds the classes once per application, and executors get them as a jar, as they get any other.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK = 1 << 20  # bytes handed to the driver's JVM at once
_loaders: dict[tuple[str, str], object] = {}


def _literal(value) -> tuple[str, str]:
    if isinstance(value, float):
        return "double", repr(value)
    if isinstance(value, int):
        return ("int", str(value)) if abs(value) < 1 << 31 else ("long", f"0x{value:X}L")
    kind = "double" if any(isinstance(x, float) for x in value) else "int"
    return f"{kind}[]", "{" + ", ".join(map(repr, value)) + "}"


def source(path: Path, constants: Mapping[str, object]) -> str:
    """The Java file with the values of ``constants`` as its fixed values."""
    kinds = {name: _literal(value) for name, value in constants.items()}
    return path.read_text().replace("/*CONSTANTS*/", "\n    ".join(f"static final {kind} {name} = {value};" for name, (kind, value) in kinds.items()))


def _package(code: str) -> str:
    """Each version of the code has a package of its own, since executors keep the classes they have."""
    return f"plumbline.v{hashlib.sha256(code.encode()).hexdigest()[:16]}"


def create(spark: SparkSession, path: Path, constants: Mapping[str, object], name: str):
    """A new object of the class ``name`` in the Java file."""
    sc = spark.sparkContext
    code = source(path, constants)
    loader = _loaders.get((sc.applicationId, code))
    if loader is None:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(code.replace("package plumbline;", f"package {_package(code)};", 1))
        made = compiler.getBytecodes()
        handle, jar = tempfile.mkstemp(prefix=f"{path.stem}-", suffix=".jar")
        with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as files:
            for each in made:
                files.writestr(each.replace(".", "/") + ".class", bytes(made[each]))
        sc._jsc.addJar(jar)
        loader = _loaders[sc.applicationId, code] = compiler.getClassLoader()
    return loader.loadClass(f"{_package(code)}.{name}").getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0))


def map_partitions(rows: DataFrame, function, schema: str) -> DataFrame:
    """What the Java ``function`` makes of each partition's rows."""
    jvm = rows.sparkSession.sparkContext._jvm
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(StructType.fromDDL(schema).json())
    return DataFrame(rows._jdf.mapPartitions(function, jvm.org.apache.spark.sql.Encoders.row(kind)), rows.sparkSession)
