"""Where the corpus operators keep intermediate tables and files, and how they size batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; without that setting a local one, if Spark is local."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="forktrack-")
            atexit.register(shutil.rmtree, base[len("file://"):], ignore_errors=True)
        _RUNS[app] = f"{base.rstrip('/')}/forktrack-{uuid.uuid4().hex}"
    return _RUNS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, outlives executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    release()
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession, batch_mb: int = 4) -> None:
    """Let workers import this package wherever they run, and bound the bytes that one Arrow batch of texts may hold.

    A bound that the user has set stays; rows are not bounded, so other queries see no difference.
    """
    _allocator()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":
        spark.conf.set(key, str(batch_mb << 20))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = tempfile.mkdtemp(prefix="forktrack-code-")
        atexit.register(shutil.rmtree, to, ignore_errors=True)
        with zipfile.ZipFile(f"{to}/forktrack.zip", "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(f"{to}/forktrack.zip")
        _SHIPPED.add(app)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def buckets(df: DataFrame) -> int:
    """Groups to deal out what is made from ``df``: the session's number, or its input splits if there are more."""
    return max(partitions(df.sparkSession), df.rdd.getNumPartitions())


def spare(df: DataFrame, name: str) -> str:
    """A name for a column that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@functools.cache
def _allocator():
    """The C library, told once to map large blocks, which go back to the system when they are freed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        return libc
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give memory that Python and Arrow have freed back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if libc := _allocator():
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of Arrow batches that leaves no freed memory with its worker when a task ends."""

    def bounded(batches):
        _allocator()
        try:
            yield from run(batches)
        finally:
            release()

    return bounded


class FileStore:
    """Create, size and range-read files by URI: local paths directly, other schemes through ``pyarrow.fs``."""

    def __init__(self, uri: str):
        parts = urlsplit(uri)
        self.remote = None
        if parts.scheme in ("", "file"):
            self.path = parts.path
        else:
            from pyarrow import fs

            self.remote, self.path = fs.FileSystem.from_uri(uri)

    def write(self, name: str, fill) -> None:
        """``fill(file)`` writes to a private name, which is then renamed: a retried task replaces its own output."""
        final, draft = f"{self.path}/{name}", f"{self.path}/.{name}.{uuid.uuid4().hex}"
        if self.remote is None:
            os.makedirs(self.path, exist_ok=True)
            with open(draft, "wb") as f:
                fill(f)
            os.replace(draft, final)
        else:
            self.remote.create_dir(self.path, recursive=True)
            with self.remote.open_output_stream(draft) as f:
                fill(f)
            self.remote.move(draft, final)

    def open(self):
        return open(self.path, "rb") if self.remote is None else self.remote.open_input_file(self.path)
