"""Functions on rows in Java, for bulk work on contents: sources beside this file, compiled by Janino (which compiles Spark's own
generated code) in the driver's JVM and sent to the executors as a jar. No compiler and no build are needed.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
import warnings
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_SOURCES = sorted(Path(__file__).parent.glob("*.java"))
#: Named by the sources, so that an application may hold several versions.
_PACKAGE = "extentlake.v" + hashlib.sha256(b"".join(s.read_bytes() for s in _SOURCES)).hexdigest()[:12]
#: Of the newest application: its id and the class loader, None if it can't compile.
_loaded: tuple = (None, None)
_lock = threading.Lock()


def _compiled(sc):
    loader, classes = sc._jvm.java.lang.Thread.currentThread().getContextClassLoader(), {}
    for source in _SOURCES:
        try:
            compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(loader)
            compiler.cook(source.read_text().replace("package extentlake;", f"package {_PACKAGE};"))
            classes |= {name: bytes(code) for name, code in compiler.getBytecodes().items()}
        except (Py4JError, TypeError) as e:
            warnings.warn(f"{source.name} doesn't compile here, the slower path in Python is taken: {e}", stacklevel=2)
            return None
        loader = compiler.getClassLoader()
    # Spark takes a jar's name once only, also where this module is loaded anew.
    jar = Path(tempfile.mkdtemp(prefix="extentlake-"), f"{_PACKAGE}-{uuid.uuid4().hex[:12]}.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in classes.items():
            z.writestr(name.replace(".", "/") + ".class", code)
    sc._jsc.addJar(str(jar))
    return loader


def map_rows(df: DataFrame, schema: StructType, name: str, *args) -> DataFrame | None:
    """The rows that the class ``name``, made of ``args``, makes of each partition's; none where there is no JVM at hand (a remote
    session) or it can't compile."""
    global _loaded
    sc = getattr(df.sparkSession, "_sc", None)
    if sc is None:
        return None
    with _lock:
        if _loaded[0] != sc.applicationId:
            _loaded = (sc.applicationId, _compiled(sc))
        loader = _loaded[1]
    if loader is None:
        return None
    given = sc._gateway.new_array(sc._jvm.Object, len(args))
    for k, arg in enumerate(args):
        given[k] = arg
    function = loader.loadClass(f"{_PACKAGE}.{name}").getConstructors()[0].newInstance(given)
    sql = sc._jvm.org.apache.spark.sql
    return DataFrame(df._jdf.mapPartitions(function, sql.Encoders.row(sql.types.DataType.fromJson(schema.json()))), df.sparkSession)
