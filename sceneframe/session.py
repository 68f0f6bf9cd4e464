"""Session-level helpers: where shared scratch tables live."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a fresh temporary folder; on a cluster an
    unset folder is an error, because a machine-local path would not survive an executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path inside the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a later step must see exactly the rows (and partition numbers) of one
    evaluation; files on shared storage survive the loss of any executor. Inside ``passing_tables`` the table goes
    at the end of the block, unless it is to ``keep``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if not keep and _passing.get() is not None:
        _passing.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end; what is made of them must be written, and kept, before."""
    paths: list[str] = []
    outer = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(outer)
        for path in paths:
            _delete(spark, path)


def removed(df: DataFrame) -> None:
    """Delete the scratch tables that ``df`` was read from; for their owner, once what was made of them is written."""
    spark = df.sparkSession
    folder = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder in path:
            _delete(spark, path)


@contextlib.contextmanager
def replacing(spark: SparkSession, path: str, parts: list[str] | None = None) -> Iterator[str]:
    """A staging folder whose content takes the place of ``path`` at the end of the block.

    If anything fails before, the staged files go and the old output stays whole. The exchange is two renames on the driver,
    undone if the second fails; no file is copied. With ``parts``, a folder that holds anything else is refused, because it
    would be lost.
    """
    fs, target = _file_system(spark, path)
    if parts is not None and fs.exists(target):
        others = sorted({str(f.getPath().getName()) for f in fs.listStatus(target)} - set(parts))
        if others:
            raise ValueError(f"{path} holds other files than {parts}: {others[:5]}")
    mark = uuid.uuid4().hex
    staged, replaced = (spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{n}-{mark}") for n in ("staged", "replaced"))
    try:
        fs.mkdirs(staged)
        yield f"{staged}/all"
        content = spark._jvm.org.apache.hadoop.fs.Path(staged, "all")
        old = fs.exists(target)
        if old:
            _rename(fs, target, replaced)
        try:
            _rename(fs, content, target)
        except Exception:
            if old:
                _rename(fs, replaced, target)
            raise
        fs.delete(replaced, True)
    finally:
        fs.delete(staged, True)


def _rename(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"cannot rename {old} to {new}")


def _file_system(spark: SparkSession, path: str):
    """The file system of a path and the path in full."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, escaped as URIs are."""
    return _file_system(spark, path)[1].toUri().toString()


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
