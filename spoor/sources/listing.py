"""Folders of very many small files: listed and read by tasks, with a table between.

Spark's file index holds every file's name and status on the driver. Here each level of the
tree is listed by tasks into a table, so the driver holds neither names nor sizes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.session import ship_package, stored

#: Opens a folder's address: a filesystem, and the folder's path in it.
Opener = Callable[[str], tuple[fs.FileSystem, str]]

FOUND = "path string, size long, is_folder boolean"
#: Bytes of the files that a task reads, and of the texts in one batch.
TASK_BYTES, BATCH_BYTES = 128 << 20, 16 << 20


def arrow_files(folder: str) -> tuple[fs.FileSystem, str]:
    """Any address that Arrow can open, such as ``/data``, ``file:/data`` or ``s3://bucket/data``."""
    address = re.sub(r"^file:/+", "/", folder)
    filesystem, path = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", address))
    return filesystem, path.rstrip("/")


def _hidden(name: str) -> bool:
    """Names that Spark's scans leave out as well."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _lister(folder: str, glob: str, opener: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = opener(folder)
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_folder", pa.bool_())])
        for batch in batches:
            for below in batch.column("path").to_pylist():
                where = f"{base}/{below}" if below else base or "/"
                found = filesystem.get_file_info(fs.FileSelector(where, allow_not_found=True))
                for at in range(0, len(found), 10_000):
                    rows = [
                        {
                            "path": f"{below}/{f.base_name}" if below else f.base_name,
                            "size": f.size or 0,
                            "is_folder": f.type == fs.FileType.Directory,
                        }
                        for f in found[at : at + 10_000]
                        if not _hidden(f.base_name)
                        and (f.type == fs.FileType.Directory or fnmatchcase(f.base_name, glob))
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def list_files(
    spark: SparkSession, folder: str, glob: str = "*", opener: Opener = arrow_files
) -> DataFrame:
    """``(path, size)`` of the files below ``folder`` whose name fits ``glob``, empty ones included.

    ``path`` is relative to ``folder``. One job per level of the tree: its folders are dealt over
    the tasks, and what they hold is a table for the next level. One folder is listed by one
    task. Hidden files are left out as in Spark's scans; a folder that is not there has no files.
    """
    ship_package(spark)
    width = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([("",)], "path string")
    files = []
    while True:
        found = stored(level.repartition(width).mapInArrow(_lister(folder, glob, opener), FOUND))
        files.append(found.filter("not is_folder").select("path", "size"))
        level = found.filter("is_folder").select("path")
        if level.isEmpty():
            break
    out = files[0]
    for more in files[1:]:
        out = out.unionByName(more)
    return out


def _reader(folder: str, opener: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = opener(folder)
        paths, contents, held = [], [], 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array(paths, pa.string()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "content"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with filesystem.open_input_stream(f"{base}/{path}", compression=None) as file:
                    content = file.read()
                paths.append(path)
                contents.append(content)
                held += len(content)
                if held >= BATCH_BYTES or len(paths) >= 10_000:
                    yield out()
                    paths, contents, held = [], [], 0
        if paths:
            yield out()

    return run


def read_listed(
    manifest: DataFrame, folder: str, opener: Opener = arrow_files, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """``(path, text)`` of the files of ``manifest (path, size)``, whole.

    Files are dealt over as many tasks as their bytes ask for; a file is read by one task.
    """
    total, files = manifest.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))
    ).first()
    tasks = max(1, min(files, -(-total // task_bytes), 1 << 20))
    dealt = manifest.select("path").repartition(tasks, "path")
    read = dealt.mapInArrow(_reader(folder, opener), "path string, content binary")
    return read.select("path", F.col("content").cast("string").alias("text"))
