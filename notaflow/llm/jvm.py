"""Functions in Java, compiled in the driver's JVM by the compiler that Spark brings along (Janino).

The classes go to a jar in the shared folder, from where Spark hands them to every executor, also to one that joins later.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from ..session import shared_dir
from .common import on_exit_deleted

#: By application and session: what is registered there.
_KNOWN: set[tuple[str, int, str]] = set()


def java_functions(spark: SparkSession, source: str, functions: dict[str, tuple[str, str]]) -> None:
    """Registers functions of the Java file `source` (beside this one): name to (nested class, result type as DDL)."""
    jvm, session = spark._jvm, spark._jsparkSession
    key = (spark.sparkContext.applicationId, session.hashCode(), source)
    if key in _KNOWN:
        return
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(Path(__file__).with_name(source).read_text())
    jar = io.BytesIO()
    classes = compiler.getBytecodes()
    with zipfile.ZipFile(jar, "w") as z:
        for name in classes:
            z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    path = f"{shared_dir(spark)}/functions-{uuid.uuid4().hex}.jar"
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(session.sessionState().newHadoopConf())
    out = files.create(where)
    out.write(jar.getvalue())
    out.close()
    on_exit_deleted(spark, path)
    session.sql(f"ADD JAR '{files.makeQualified(where).toString()}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    package = next(iter(classes)).rpartition(".")[0]
    for name, (cls, result) in functions.items():
        f = jvm.java.lang.Class.forName(f"{package}.{source.partition('.')[0]}${cls}", True, loader).getConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
        session.udf().register(name, f, jvm.org.apache.spark.sql.types.DataType.fromDDL(result))
    _KNOWN.add(key)
