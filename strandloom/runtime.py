"""Session helpers shared by all operators: table access, durable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_runs: dict[str, str] = {}
_shipped: set[str] = set()
_open: list[list[Workspace]] = []  # of the blocks that delete what is written in them


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need no install."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="strandloom-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{here.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a test-data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (one
    JVM, as in tests) may fall back to a temporary folder of this machine.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, _runs[app], True)
    return f"file://{_runs[app]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Written tables that cut lineage and survive the loss of executors.

    ``save`` writes a DataFrame as Parquet below the shared folder and reads it
    back, so a lost executor costs a re-read and never a recomputation of the
    iterations before. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        fs, path = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # with the session, not before: results are read lazily
        if _open:
            _open[-1].append(self)

    def _hadoop(self, path: str):
        """File system and path object of a location."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table as written; ``by``: a folder for each value of that column, so that a filter on it reads no other."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._strandloom_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables written by ``save``; other DataFrames are ignored."""
        for df in frames:
            path = getattr(df, "_strandloom_path", None)
            if path:
                fs, p = self._hadoop(path)
                fs.delete(p, True)

    def close(self) -> None:
        """Delete all tables, once nothing lazy reads them any more."""
        fs, p = self._hadoop(self.root)
        fs.delete(p, True)


@contextmanager
def workspaces_of_block() -> Iterator[None]:
    """Tables that are written inside the block are deleted at its end; nothing lazy may outlive it."""
    _open.append([])
    try:
        yield
    finally:
        for w in _open.pop():
            w.close()
