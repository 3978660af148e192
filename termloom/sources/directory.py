"""A directory tree of Markdown and text files as a corpus."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.analyze import title
from termloom.functions.ids import hashes, path_id
from termloom.runtime import written

# The files of a corpus, as a glob and as a pattern.
_GLOB = "*.{[mM][dD],[tT][xX][tT]}"
_WANTED = re.compile(rb"\.(md|txt)\Z", re.IGNORECASE)



#: Directory entries that one task of a listing takes before it hands on the directories it has not come to.
WALK_ENTRIES = 50_000
#: Files, or bytes of them, that one task reads.
READ_FILES, READ_BYTES = 20_000, 32 << 20
#: Files in one folder of those that write_files makes.
FOLDER_FILES = 1000

_LISTED = "doc_id string, path string, modified_time bigint, _file binary, _size bigint, _left binary"


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file:")


def _local_path(root: str) -> str:
    return os.path.abspath(re.sub("^file:/+", "/", root))


def scan_directory(spark: SparkSession, root: str, with_content: bool | DataFrame = True) -> DataFrame:
    """(doc_id, path, modified_time[, raw, error]) of all .md and .txt files below root, whatever the case of the extension.

    modified_time is in epoch seconds. Paths are given below root as it was written. The names and times are those of
    the call; without content no file is opened, with a table of doc_ids for it only those files are given and opened. Below a local root (on a cluster, a folder all executors mount) the tasks list the
    directories, and a file that can't be read has a null raw and the reason in error; elsewhere Spark's own reader lists and opens the
    files and fails the job. Raises FileNotFoundError for a root that isn't a directory.
    """
    if is_local(root):
        if not os.path.isdir(_local_path(root)):
            raise FileNotFoundError(f"not a directory: {root}")
        listed = _listed(spark, root)
        if isinstance(with_content, DataFrame):  # before the read: Spark doesn't move a join below it
            listed = listed.join(with_content.select("doc_id"), "doc_id", "left_semi")
        if with_content is False:
            return listed.select("doc_id", "path", "modified_time")
        n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
        spread = listed.repartition(1 + max(n // READ_FILES, size // READ_BYTES), "doc_id")
        read = spread.select("doc_id", "path", "modified_time", _read_local(F.col("_file")).alias("_read"))
        return read.select("doc_id", "path", "modified_time", "_read.raw", "_read.error")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(root)
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 2)))
    columns = [path.alias("path"), F.col("modificationTime").cast("long").alias("modified_time")]
    if with_content is not False:
        columns += [F.col("content").alias("raw"), F.lit(None).cast("string").alias("error")]
    scanned = files.select(*columns).select(path_id(F.col("path")).alias("doc_id"), "*")
    return scanned.join(with_content.select("doc_id"), "doc_id", "left_semi") if isinstance(with_content, DataFrame) else scanned


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, modified_time, _file, _size) of the files below a local root, kept as a table: no list passes through the driver.

    A task walks on from the directories it was given; what it leaves is dealt out for the next round, until nothing is left.
    """
    top, shown = os.fsencode(_local_path(root)), os.fsencode(root.rstrip("/"))
    cut_off, most = len(top.rstrip(b"/")), WALK_ENTRIES

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[tuple[bytes, int, int]] = []
        left: list[bytes] = []
        seen = 0
        for batch in batches:
            left += batch.column(0).to_pylist()
            while left and seen < most:
                with os.scandir(left.pop()) as entries:
                    for e in entries:
                        seen += 1
                        if _hidden(os.fsdecode(e.name)):
                            continue
                        try:
                            inner, wanted = e.is_dir(), _WANTED.search(e.name) and e.is_file()
                        except OSError:  # a link that leads nowhere
                            continue
                        if inner:
                            left.append(e.path)
                        elif wanted:
                            stat = e.stat()
                            files.append((e.path, stat.st_mtime_ns // 1_000_000_000, stat.st_size))
                            if len(files) == 10_000:
                                yield rows(files, [])
                                files = []
            while len(left) > 10_000:
                yield rows([], [left.pop() for _ in range(10_000)])
        yield rows(files, left)

    def rows(files: list[tuple[bytes, int, int]], left: list[bytes]) -> pa.RecordBatch:
        names, none, nothing = [shown + f[0][cut_off:] for f in files], [None] * len(left), [None] * len(files)
        columns = [
            pa.array(hashes(names) + none, pa.string()),
            pa.array([x.decode(errors="replace") for x in names] + none, pa.string()),
            pa.array([f[1] for f in files] + none, pa.int64()),
            pa.array([f[0] for f in files] + none, pa.binary()),
            pa.array([f[2] for f in files] + none, pa.int64()),
            pa.array(nothing + left, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "modified_time", "_file", "_size", "_left"])

    rounds: list[DataFrame] = []
    given = spark.createDataFrame([(top,)], "directory binary").coalesce(1)
    while True:
        rounds.append(written(given.mapInArrow(walk, _LISTED), "listing"))
        left = rounds[-1].where(F.col("_left").isNotNull()).select(F.col("_left").alias("directory"))
        if left.isEmpty():
            break
        given = left.repartition(4 * spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, rounds).where(F.col("_file").isNotNull()).drop("_left")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return hidden and not name.startswith(("_metadata", "_common_metadata"))


def write_files(rows: DataFrame, root: str) -> None:
    """Rows of (name, content in bytes) as files below a local root, written by the tasks that hold them.

    A task's folder gets its name when all its files are there, so one that is run again leaves no others. A name may occur in many rows:
    files lie in numbered folders and have a number before their name.
    """
    top = _local_path(root)
    os.makedirs(top, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        aside, n = f"{top}/.{task.taskAttemptId()}", 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n % FOLDER_FILES == 0:
                    folder = f"{aside}/{n // FOLDER_FILES}"
                    os.makedirs(folder)
                with open(f"{folder}/{n}-{name}", "wb", buffering=0) as f:
                    f.write(content)
                n += 1
        if n:
            try:
                os.rename(aside, f"{top}/{task.partitionId()}")
            except OSError:  # another attempt of the same task was first
                if not os.path.isdir(f"{top}/{task.partitionId()}"):
                    raise
                shutil.rmtree(aside)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.mapInArrow(put, "n bigint").write.format("noop").mode("overwrite").save()


def _read_local(file: Column) -> Column:
    """(raw, error) of local files. What a file gives may change: Spark must not read it again for a filter on error."""

    @F.pandas_udf("raw binary, error string")
    def read(files: pd.Series) -> pd.DataFrame:
        raw: list[bytes | None] = []
        error: list[str | None] = []
        for f in files:
            try:
                with open(f, "rb") as opened:
                    raw.append(opened.read())
                error.append(None)
            except OSError as e:
                raw.append(None)
                error.append(e.strerror or type(e).__name__)
        return pd.DataFrame({"raw": pd.Series(raw, dtype=object), "error": pd.Series(error, dtype=object)})

    return read.asNondeterministic()(file)


def as_corpus(scanned: DataFrame) -> DataFrame:
    """(doc_id, path, title, content, modified_time, error): bytes that aren't UTF-8 are kept as replacement characters."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    content = F.coalesce(F.try_validate_utf8(F.col("raw").cast("string")), F.make_valid_utf8(F.col("raw").cast("string")))
    return scanned.select("doc_id", "path", title(content, stem).alias("title"), content.alias("content"), "modified_time", "error")
