"""Intermediate tables that survive the loss of an executor.

``durable`` writes a frame as Parquet under the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back, which cuts the lineage and gives the
planner real sizes. Only where that setting is absent and the master is local (tests, a laptop) does it
choose a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one if unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def durable(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again. Empty frames keep their schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _LEFT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._shelfmark_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints``
    its files go when no plan refers to it any more, which suits frames that are handed out inside a lazy result."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of what finished plans hold: Spark drops their broadcast tables, shuffles and checkpoints once the driver
    has collected its garbage, which else waits until its heap has grown to the full. The heap shrinks to what is left in
    it, and what the JVM's compiler and threads have freed outside it goes back to the system, where the JVM has a command for it."""
    gc.collect()
    collect(spark)
    with contextlib.suppress(Exception):
        trim_native(spark)


def collect(spark: SparkSession) -> None:
    """A full collection that leaves no more of the heap free than the JVM asks for at least (its default: 40 %). Of itself
    it keeps up to 70 %, which then fills with garbage before it is collected again. The JVM's setting is put back."""
    was = None
    with contextlib.suppress(Exception):  # a JVM without these settings collects as it does
        least, was = vm_option(spark, "MinHeapFreeRatio"), vm_option(spark, "MaxHeapFreeRatio")
        set_vm_option(spark, "MaxHeapFreeRatio", least)
    spark.sparkContext._jvm.System.gc()
    if was is not None:
        with contextlib.suppress(Exception):
            set_vm_option(spark, "MaxHeapFreeRatio", was)


def vm_option(spark: SparkSession, name: str) -> str:
    return _ask_jvm(spark, "HotSpotDiagnostic", "getVMOption", name).get("value")


def set_vm_option(spark: SparkSession, name: str, value: str) -> None:
    _ask_jvm(spark, "HotSpotDiagnostic", "setVMOption", name, value)


def trim_native(spark: SparkSession) -> str:
    """What the JVM says of the native memory it gave back."""
    return _ask_jvm(spark, "DiagnosticCommand", "systemTrimNativeHeap")


def _ask_jvm(spark: SparkSession, bean: str, operation: str, *words: str):
    """The answer of one of the JVM's own beans to an operation on strings. Called through the interface, as the classes behind it are closed."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation
    if words:
        given[2], given[3] = gateway.new_array(jvm.java.lang.Object, len(words)), gateway.new_array(jvm.java.lang.String, len(words))
        for i, word in enumerate(words):
            given[2][i], given[3][i] = word, "java.lang.String"
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``durable`` that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_shelfmark_path", None):
            _delete(df.sparkSession, path)


def stored(df: DataFrame) -> bool:
    """Whether the table that ``durable`` wrote for the frame is still there."""
    hadoop, fs = _at(df.sparkSession, df._shelfmark_path)
    return fs.exists(hadoop)


def files_of(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each file of a table: another tuple once the table is written anew."""
    hadoop, fs = _at(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(hadoop)))


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, fs = _at(spark, path)
    fs.delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _LEFT:
        if spark.sparkContext._jsc is None:  # stopped already
            continue
        with contextlib.suppress(Exception):  # one folder that cannot be deleted does not keep the others
            _delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path where they run on this machine, else as an archive that Spark sends them."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        env = sc.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    elif _SHIPPED.get("to") != sc.applicationId:
        folder = tempfile.mkdtemp(prefix="shelfmark-code-")  # the driver's; Spark copies the archive from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "shelfmark.zip")
        with zipfile.ZipFile(path, "w") as out:
            for top, _, names in os.walk(os.path.join(root, "shelfmark")):
                for name in names:
                    if name.endswith(".py"):
                        at = os.path.join(top, name)
                        out.write(at, os.path.relpath(at, root))
        sc.addPyFile(path)
        _SHIPPED["to"] = sc.applicationId
