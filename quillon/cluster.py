"""Making this package importable by the Python workers of any cluster."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_FOLDERS: list[str] = []


def _own_folder(prefix: str) -> str:
    """A folder on the driver's machine that goes at exit."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(str(path.relative_to(root.parent)), path.read_bytes())
    name = Path(_own_folder("quillon-src-")) / "quillon_src.zip"  # the driver serves it from there
    name.write_bytes(data.getvalue())
    context.addPyFile(str(name))
    _SHIPPED.add(context.applicationId)


#: Rows that a Python worker gets at once while an intermediate table is written: texts are long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller batches for what runs inside, where the session has left Spark's default; it has its own setting again after."""
    own = spark.conf.get(_BATCH)
    if own != "10000":
        yield
        return
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, own)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, a folder of our own.

    In local mode that is a temporary folder removed at exit. A cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        if not _LOCAL_FOLDERS:
            _LOCAL_FOLDERS.append(_own_folder("quillon-"))
        folder = "file://" + _LOCAL_FOLDERS[0]
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they lie now, written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
