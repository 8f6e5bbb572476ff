"""Where intermediate files go: always the shared folder the cluster names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or set on its context. Nothing is made up: without one it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a written intermediate table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this session has just written."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's setting for the shuffle files of a query: removed when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind for the steps after them, unless the session says what becomes of those. For tables that are
    read from what is written only: their plans are not run again."""
    if _CLEANUP in spark.conf.getAll:
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP)


def listed_names(spark: SparkSession, base: str) -> list[str]:
    """Names directly below a folder. The driver sees names only; one entry per stored run."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def first_lines(spark: SparkSession, base: str, names: Sequence[str], encoding: str = "UTF-8") -> dict[str, set[str]]:
    """The first lines of the files that lie directly below a folder, or in one of the folders there; empty files have none. Only the beginnings of
    files are read, some at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(path) -> str | None:
        stream = fs.open(path)
        try:
            codec = codecs.getCodec(path)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding)).readLine()
        finally:
            stream.close()

    def heads(name: str) -> set[str]:
        path = jvm.org.apache.hadoop.fs.Path(root, name)
        files = [path] if fs.isFile(path) else [s.getPath() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        return {line for line in map(head, files) if line is not None}

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(names, pool.map(heads, names)))
