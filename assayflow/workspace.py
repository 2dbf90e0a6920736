"""Shared storage for iterative jobs: lineage is cut by writing a table that every executor can read again. And the package for the workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_live: dict[str, SparkSession] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a local master (tests, one machine) a temporary folder of this driver.
    On a cluster an unset folder is refused: executors on other machines could not read this one's."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="assayflow-")
    return _own_dirs[app]


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back. Returns the table and its path, for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for path in paths:
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
            _live.pop(path, None)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application, wherever the driver runs."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="assayflow-")) / f"assayflow-{sc.applicationId}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_live.items()):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            _live.pop(path, None)
