"""Folders for tables that a plan writes and reads again, on storage that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

from deltaloom.errors import ConfigError


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. If that is unset, a temporary folder, where all executors are this process;
    on a cluster an error, as each executor would write to a disk of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ConfigError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
    return f"file://{tempfile.gettempdir()}"


_OPEN: list[Scratch] = []


@contextmanager
def freed_after() -> Iterator[None]:
    """Drops, at the end, all scratch tables made inside: for callers that have by then written what they need of them."""
    before = len(_OPEN)
    try:
        yield
    finally:
        while len(_OPEN) > before:
            _OPEN.pop().drop()


class Scratch:
    """A folder of its own under the shared folder.

    Tables written here cut lineage: a lost executor costs only the tasks that were running, and what is read back
    has one fixed order and partitioning. ``drop`` frees what a later step has replaced; the rest goes when the
    program ends.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/deltaloom-{purpose}-{uuid.uuid4().hex}"
        atexit.register(self._forget)
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads. What the write has shuffled is freed at once: nothing reads it any more."""
        before = self.spark.conf.get(_FREE, "false")
        self.spark.conf.set(_FREE, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(_FREE, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _forget(self) -> None:
        with suppress(Exception):  # the session may have ended, and its storage with it
            self.drop()
