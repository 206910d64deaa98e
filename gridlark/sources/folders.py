"""Folders of very many small files.

Spark's file sources keep every file's status in the driver and put a few dozen
files into a task.  Here a task lists a folder and hands its names out as rows,
and tasks read the files of their share of the names; the driver holds neither.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from gridlark.operators.quality import ConstraintError
from gridlark.sources.sinks import file_system

NAMES, BYTES = 4096, 1 << 22


def readable(path: str) -> bool:
    """Whether this is one path, on a file system that tasks can read by themselves."""
    try:
        return not set(path) & set("*?[{,") and file_system(path)[1] != ""
    except ConstraintError:
        return False


def is_folder(path: str) -> bool:
    if not readable(path):
        return False
    there, at = _place(path)
    return there.get_file_info(at).type == fs.FileType.Directory


def _hidden(name: str) -> bool:
    """What Spark's own readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(there: fs.FileSystem, at: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, one after another where the file system allows it, and whether they are folders."""
    if isinstance(there, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for x in found:
                yield x.name, x.is_dir()
    else:
        for i in there.get_file_info(fs.FileSelector(at)):
            yield i.base_name, i.type == fs.FileType.Directory


def _walk(there: fs.FileSystem, at: str, recursive: bool) -> Iterator[str]:
    folders = [""]
    while folders:
        folder = folders.pop()
        for name, is_folder in _entries(there, posixpath.join(at, folder)):
            if _hidden(name):
                continue
            if not is_folder:
                yield posixpath.join(folder, name)
            elif recursive:
                folders.append(posixpath.join(folder, name))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    there, at = file_system(path)
    return there, at.rstrip("/") or "/"


def names(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False) -> DataFrame:
    """``name`` of each file in a folder, below it if ``recursive``, relative to the
    folder; the path of one file gives its own name."""
    there, at = _place(path)
    if there.get_file_info(at).type == fs.FileType.NotFound:
        raise ConstraintError(f"{path} does not exist")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        there, at = _place(path)
        one = there.get_file_info(at).type == fs.FileType.File
        some = []
        for name in [posixpath.basename(at)] if one else _walk(there, at, recursive):
            if name.endswith(suffix):
                some.append(name)
            if len(some) == NAMES:
                yield pa.record_batch([pa.array(some, pa.string())], ["name"])
                some = []
        yield pa.record_batch([pa.array(some, pa.string())], ["name"])

    return spark.range(1, numPartitions=1).mapInArrow(listed, "name string")


def contents(found: DataFrame, path: str, unpack: bool = False) -> DataFrame:
    """``(name, content)`` of the files of these names; ``unpack`` undoes a compression that the name tells."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, at = _place(path)
        if there.get_file_info(at).type == fs.FileType.File:
            at = posixpath.dirname(at)
        for batch in batches:
            some, held, size = [], [], 0
            for name in batch.column("name").to_pylist():
                with there.open_input_stream(posixpath.join(at, name), compression="detect" if unpack else None) as f:
                    held.append(f.read())
                some.append(name)
                size += len(held[-1])
                if size >= BYTES:
                    yield _files(some, held)
                    some, held, size = [], [], 0
            yield _files(some, held)

    # a share is a number of names, however few bytes they take
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select("name").repartition(tasks, "name").mapInArrow(read, "name string, content binary")


def _files(some: list[str], held: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(some, pa.string()), pa.array(held, pa.binary())], ["name", "content"])
