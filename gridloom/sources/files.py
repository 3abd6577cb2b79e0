"""Files by path or URI, on the driver and on executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where that is unset and all runs in one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, root[len("file://") :], True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_whole(path: str, data: bytes) -> None:
    """Writes a file under another name and renames it, so that it appears whole or not at all."""
    mark = f"{path}.{uuid.uuid4().hex[:8]}.part"
    if path.startswith("file:") or "://" not in path:
        own, mark = (_local(p) for p in (path, mark))
        os.makedirs(os.path.dirname(own) or ".", exist_ok=True)
        with open(mark, "wb") as f:
            f.write(data)
        os.replace(mark, own)
        return
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path)
    mark = own + mark[len(path) :]
    store.create_dir(os.path.dirname(own), recursive=True)
    with store.open_output_stream(mark) as f:
        f.write(data)
    store.move(mark, own)


def _local(path: str) -> str:
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path
