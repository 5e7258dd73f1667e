"""Scratch tables and memory-mapped arrays in the cluster's shared folder.

The folder is the one that ``spark.checkpoint.dir`` names.  Only where that is
unset (tests, a laptop) a folder of our own is made.  Tables cut the lineage:
what they hold survives the loss of any executor.
"""

from __future__ import annotations

import contextlib
import mmap
import os
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a scratch table's row groups, which a task holds while it writes.
ROW_GROUP = 16 << 20

_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets one of our own only if none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tideline-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path if ":" in path.split("/", 1)[0] else "file://" + os.path.abspath(path)


def new_path(spark: SparkSession, name: str, owner: str = "op") -> str:
    """A path that no other call gets; ``release(spark, owner)`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/tideline/{uuid.uuid4().hex}/{name}"
    _scratch.setdefault(owner, []).append(path)
    return path


def table(df: DataFrame, name: str, owner: str = "op") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name, owner)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    free_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_driver(spark: SparkSession) -> None:
    """Give memory that the driver's JVM no longer uses outside its heap back to the system.

    Planning and compiling a query takes much of it for a moment, and the C library
    keeps it: what a driver of many queries holds is else the sum of its threads' peaks.
    """
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):  # a JVM before 17.0.9 or a C library without it
        server, kind = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        arguments = spark.sparkContext._gateway.new_array(jvm.Object, 4)  # the command takes none itself
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, arguments)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of ``owner``; nothing may read them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _scratch.pop(owner, []):
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(conf).delete(p, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint only if its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


# --- memory-mapped arrays ---------------------------------------------------


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_array(uri: str, array: np.ndarray) -> None:
    """Write the bytes of ``array`` to ``uri``; a retried task replaces the file."""
    if uri.startswith("file:"):
        path = uri.removeprefix("file://")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
        os.replace(part, path)
        return
    system, path = _filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(array).tobytes())


def map_array(uri: str, dtype: str) -> np.ndarray:
    """The array at ``uri``, memory-mapped read-only.

    A ``file:`` folder is mapped where it lies.  Files of any other store are
    first copied to an unnamed temporary file, which goes with the mapping.
    """
    if uri.startswith("file:"):
        handle = open(uri.removeprefix("file://"), "rb")
    else:
        system, path = _filesystem(uri)
        handle = tempfile.TemporaryFile()
        with system.open_input_stream(path) as stream:
            while chunk := stream.read(1 << 22):
                handle.write(chunk)
        handle.flush()
    with handle:
        if not os.fstat(handle.fileno()).st_size:
            return np.empty(0, dtype)
        return np.frombuffer(mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ), dtype)
