"""Where iterative operators put their per-round tables.

Lineage is cut by writing each round as a Parquet table under the shared folder the
cluster names in ``spark.checkpoint.dir`` and reading it back. Parquet rather than
``DataFrame.checkpoint()`` because the pair tables are two long columns: columnar
encoding makes them several times smaller than serialised rows, and the re-read carries
file statistics that AQE uses for its join and partition decisions. A lost executor
costs nothing: the table is on shared storage and the read is an ordinary scan.

The library never chooses the folder; the tests, the bench and the driver contract set one where
a local session has none.
"""

from __future__ import annotations

import contextlib
import json
import logging
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; raises if the session has none."""
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError(
            "linkfold needs a shared checkpoint folder: set spark.checkpoint.dir "
            "(or call SparkContext.setCheckpointDir) before running iterative operators")
    return root.rstrip("/")


class Scratch:
    """The tables written while it was open; ``release`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def release(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())


_open: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[Scratch]:
    """Owns every scratch table written inside the block. They are deleted when it ends; with ``keep`` only when it
    raises, and else by the handle's ``release`` once the lazy results that read them are no longer needed."""
    mine = Scratch(spark)
    _open.append(mine)
    try:
        yield mine
    except BaseException:
        mine.release()
        raise
    else:
        if not keep:
            mine.release()
    finally:
        _open.remove(mine)


def new_scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, never reused path under the checkpoint folder, owned by every open ``scratch`` block."""
    path = f"{checkpoint_root(spark)}/linkfold-{tag}-{uuid.uuid4().hex[:12]}"
    for owner in _open:
        owner.paths.append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


class RunManifest:
    """What a named run has finished, in the checkpoint folder, so that a new driver can go on with it.

    ``write`` puts one small JSON file for each round: written under another name and renamed, so a
    reader sees it whole or not at all. ``last`` is the state of the latest round. The run's tables lie in the same
    folder and belong to no ``scratch`` block: they outlive a failed driver, and ``drop`` deletes them all.
    """

    def __init__(self, spark: SparkSession, name: str):
        if not name or not all(c.isalnum() or c in "-_." for c in name) or name.startswith("."):
            raise ValueError(f"a run's name has letters, digits, '-', '_' and '.' only, got {name!r}")
        self.spark, self.folder = spark, f"{checkpoint_root(spark)}/linkfold-run-{name}"

    def table_path(self, tag: str) -> str:
        """A path that no earlier attempt has used: a table that was cut off halfway is never read."""
        return f"{self.folder}/{tag}-{uuid.uuid4().hex[:12]}"

    def write(self, step: int, state: dict) -> None:
        fs, folder = _file_system(self.spark, self.folder)
        fs.mkdirs(folder)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        draft = path(f"{self.folder}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.writeBytes(json.dumps({"step": step, **state}))   # ASCII
        out.close()
        final = path(f"{self.folder}/manifest-{step:06d}.json")
        if fs.exists(final):   # of an attempt whose later tables are gone
            fs.delete(final, False)
        if not fs.rename(draft, final):
            raise OSError(f"could not rename {draft} to {final}")

    def last(self) -> dict | None:
        fs, folder = _file_system(self.spark, self.folder)
        if not fs.exists(folder):
            return None
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True)
        jvm = self.spark.sparkContext._jvm
        for name in names:
            if name.startswith("manifest-"):
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"))
                try:
                    return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return None

    def drop(self) -> None:
        drop_path(self.spark, self.folder)


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and return the scan of what was written
    (with the schema already known, so reading it back starts no inference job)."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a finished table through the Hadoop file system. Cleanup never fails a finished job, but a
    failure is logged, as it fills the store."""
    try:
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hpath, True)
    except Exception as exc:  # noqa: BLE001
        log.warning("could not delete %s: %s", path, exc)
