"""The folder that the driver and all executors share, and jobs that exchange packed arrays.

On a cluster it is the one that ``spark.checkpoint.dir`` names; where that is
unset and Spark runs in one process (tests) a temporary one of this machine is set.
Files are written under another name and then renamed, so that a task that runs twice
does no harm. Folders of jobs are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; set to a temporary folder only where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, root[len("file://") :], True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@dataclass(frozen=True)
class SharedDir:
    """A folder of one job in the shared folder, by URI; usable on driver and executors."""

    uri: str

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> SharedDir:
        made = cls(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
        _MADE.append(made)
        return made

    def sub(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def _local(self) -> str | None:
        if self.uri.startswith("file:"):
            return "/" + self.uri[len("file:") :].lstrip("/")
        return None if "://" in self.uri else self.uri

    def _remote(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, *parts: bytes | np.ndarray) -> None:
        """Writes the parts behind each other; the file appears whole or not at all."""
        mark = f"{name}.{uuid.uuid4().hex[:8]}.part"
        if top := self._local():
            os.makedirs(os.path.dirname(f"{top}/{name}"), exist_ok=True)
            with open(f"{top}/{mark}", "wb") as f:
                for p in parts:
                    f.write(memoryview(np.ascontiguousarray(p)).cast("B") if isinstance(p, np.ndarray) and p.size else bytes(p) if not isinstance(p, np.ndarray) else b"")
            os.replace(f"{top}/{mark}", f"{top}/{name}")
            return
        files, top = self._remote()
        files.create_dir(os.path.dirname(f"{top}/{name}"), recursive=True)
        with files.open_output_stream(f"{top}/{mark}") as f:
            for p in parts:
                f.write(p.tobytes() if isinstance(p, np.ndarray) else p)
        files.move(f"{top}/{mark}", f"{top}/{name}")

    def open(self, name: str):  # noqa: ANN201
        """A binary file for reading."""
        if top := self._local():
            return open(f"{top}/{name}", "rb")
        files, top = self._remote()
        return files.open_input_file(f"{top}/{name}")

    def map(self, name: str) -> np.ndarray:
        """The file as memory-mapped bytes. From a remote store it is fetched once and its name removed after mapping."""
        if top := self._local():
            path = f"{top}/{name}"
            return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
        with self.open(name) as f, tempfile.NamedTemporaryFile() as copy:
            shutil.copyfileobj(f, copy)
            copy.flush()
            return np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.empty(0, np.uint8)

    def exists(self, name: str) -> bool:
        if top := self._local():
            return os.path.exists(f"{top}/{name}")
        files, top = self._remote()
        return files.get_file_info(f"{top}/{name}").type.name == "File"

    def drop(self) -> None:
        if top := self._local():
            shutil.rmtree(top, ignore_errors=True)
            return
        files, top = self._remote()
        files.delete_dir(top)


_MADE: list[SharedDir] = []


@atexit.register
def _remove() -> None:
    for folder in _MADE:
        with contextlib.suppress(Exception):  # the store may be gone by then
            folder.drop()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: the lineage ends there."""
    spark = df.sparkSession
    path = SharedDir.new(spark, name).uri
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def buckets_for(spark: SparkSession, df: DataFrame) -> int:
    """How many buckets to deal packed arrays to: as many as shuffle partitions, at least one for each part of the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_partitions(df))
