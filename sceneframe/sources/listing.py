"""Files of a folder tree, listed by tasks.

The folders of one level are shared out over tasks, which list them through ``pyarrow.fs``; the folders that they find are the
next level. Jobs follow the depth of the tree. The driver holds no names, only the number of folders of a level.
"""

from __future__ import annotations

import functools
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.session import full_uri, written

FOLDERS_PER_TASK = 8
MOST_TASKS = 10_000
NAMES_PER_BATCH = 10_000


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size)`` of every file below ``folder``, each once; names that begin with ``_`` or ``.`` are left out, as Spark does.

    Paths have the form of ``input_file_name``, unescaped.

    The tree is listed when the function is called, into tables of the shared folder, so that all later uses see the same
    files. A folder that goes away meanwhile counts as empty; a missing ``folder`` is an error, and an empty one gives no row.
    One folder is listed by one task. Links to folders are followed, so a link to a folder above itself must not occur.
    The store must be one that ``pyarrow.fs`` opens.
    """
    uri = full_uri(spark, folder)
    _, root = files.FileSystem.from_uri(uri)
    prefix = unquote(uri).removesuffix(root)

    def expand(batches):
        system, _ = files.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = system.get_file_info(files.FileSelector(path, allow_not_found=path != root))
                found = [f for f in found if f.base_name[:1] not in ("_", ".") and f.type != files.FileType.NotFound]
                for at in range(0, len(found), NAMES_PER_BATCH):
                    part = found[at:at + NAMES_PER_BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()),
                         pa.array([f.type == files.FileType.Directory for f in part], pa.bool_())], ["path", "size", "is_folder"])

    levels, folders, count = [], spark.createDataFrame([(root,)], "path string"), 1
    while count:
        tasks = min(MOST_TASKS, -(-count // FOLDERS_PER_TASK))
        level = written(folders.repartition(tasks, "path").mapInArrow(expand, "path string, size long, is_folder boolean"), "listing")
        levels.append(level.where(~F.col("is_folder")).select(F.concat(F.lit(prefix), "path").alias("path"), "size"))
        folders = level.where("is_folder").select("path")
        count = folders.count()
    return functools.reduce(DataFrame.unionAll, levels)
