"""The folder that all executors share, tables in it, and what Python workers need.

A table that is written here belongs to its application: it lies below <shared folder>/edgeloom/<application>, and
release() deletes that folder; it is called when the driver's Python ends. discard() deletes one table before that.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Where each table that materialise() wrote lies.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_roots: dict[str, str] = {}
_shipped: set[str] = set()
_watched: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Do the driver and all executors live in one process?"""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and one machine runs everything, as in tests."""
    root = _configured(spark)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _roots.get(spark.sparkContext.applicationId)
    if not root:
        root = _roots[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="edgeloom-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as Spark resolves it: what is written and what is read is then the same place."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def arrow_place(uri: str):
    """(file system, path) with which executors write bytes that no Spark sink takes; uri as qualified() gives it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def _home(spark: SparkSession) -> str:
    return qualified(spark, f"{shared_dir(spark).rstrip('/')}/edgeloom/{spark.sparkContext.applicationId}")


def new_path(spark: SparkSession, name: str) -> str:
    home = _home(spark)
    if home not in _watched:
        _watched.add(home)
        atexit.register(_at_end, spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def _at_end(spark: SparkSession, home: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the cluster may be gone already
            _delete(spark, home)


def release(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that were not written elsewhere can't be read any more."""
    _delete(spark, _home(spark))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote and nothing reads any more."""
    for df in tables:
        if path := _written.pop(df, None):
            _delete(df.sparkSession, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back, so later jobs depend on no executor and repeat nothing."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    df.write.option("compression", "zstd").parquet(path)
    # a join may broadcast a table by the size of its files; those of ids and counts are several times smaller than their rows
    if conf.get("spark.sql.sources.fileCompressionFactor", "1.0") == "1.0":
        conf.set("spark.sql.sources.fileCompressionFactor", "8.0")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def path_of(df: DataFrame) -> str:
    """Where a table lies that materialise() wrote."""
    return _written[df]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application; to be called before a function for them is made."""
    app = spark.sparkContext.applicationId
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _shipped or not os.path.isdir(top):  # a package within an archive was sent by whoever put it there
        return
    name = os.path.basename(top)
    folder = tempfile.mkdtemp(prefix="edgeloom-package-")  # the driver serves it from there as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{name}-{app}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(f"{at}/{f}", f"{name}/{os.path.relpath(f'{at}/{f}', top)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
