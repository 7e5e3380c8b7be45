"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where no spark.checkpoint.dir is set and the master is local (tests).
_local_root: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master."""
    for key in ("spark.checkpoint.dir",):
        value = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
        if value:
            return value.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="codeloom-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return "file://" + _local_root[0]


#: Open scopes with the workspaces that were made within them.
_scopes: list[list[Workspace]] = []


@contextlib.contextmanager
def scope():
    """Intermediate tables of what is planned within go at its end: for the requests of a long-lived session, whose results must be read within."""
    mine: list[Workspace] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for ws in mine:
            ws.drop(ws.root)
            atexit.unregister(ws.drop)


class Workspace:
    """Intermediate tables of one operator run, written once and read back.

    A written table survives the loss of executors, is computed exactly once and is
    columnar, so that a later step reads only the columns it needs. Tables no later
    step reads are removed with :meth:`drop`; what the result still reads stays until
    the application, or the :func:`scope` around it, ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop, self.root)
        for scope in _scopes:
            scope.append(self)

    def cut(self, df: DataFrame, name: str = "step") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._codeloom_path = path
        return out

    def counted(self, df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
        """The written table and its number of rows, counted while it is written."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, what: DataFrame | str) -> None:
        path = what if isinstance(what, str) else getattr(what, "_codeloom_path", None)
        if not path:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended already
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def _file(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_bytes(spark: SparkSession, name: str) -> bytes | None:
    """A small file of the shared folder, or None."""
    path, fs = _file(spark, name)
    if not fs.exists(path):
        return None
    return bytes(spark.read.format("binaryFile").load(str(path)).select("content").first()[0])


def write_bytes(spark: SparkSession, name: str, data: bytes) -> None:
    """Writes a small file of the shared folder; readers see it whole or not at all."""
    path, fs = _file(spark, name)
    temp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(data))
    out.close()
    if not fs.rename(temp, path):  # another writer was first, with the same content
        fs.delete(temp, False)
