"""Small files and whole folders that change in one step, on whatever file system the path names."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that holds ``text``: written beside ``path``, which then takes its name, replacing an older file."""
    at, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(at), how)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """The folder ``staged`` takes the name ``path``. An older folder there is set aside first and deleted only after
    that; if the staged one cannot be moved, the older one comes back."""
    (new, fs), (at, _), (old, _) = (_path(spark, p) for p in (staged, path, f"{path}.old"))
    aside = fs.exists(at)
    if aside:
        fs.delete(old, True)
        _rename(fs, at, old)
    try:
        _rename(fs, new, at)
    except OSError:
        if aside:
            _rename(fs, old, at)
        raise
    fs.delete(old, True)


def _rename(fs, a, b) -> None:
    """File systems report a rename that failed by their answer or by an exception."""
    try:
        done = fs.rename(a, b)
    except Py4JJavaError as e:
        raise OSError(f"{a.toString()} cannot be moved to {b.toString()}") from e
    if not done:
        raise OSError(f"{a.toString()} cannot be moved to {b.toString()}")
