"""Session helpers: a local session for tests and benches, and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of every executor, once for each application.

    Rows here hold whole texts, and memory of Python and JVM follows the Arrow batch, so a session that
    doesn't set the rows of a batch itself gets ``ARROW_ROWS``.
    """
    if spark.conf.get(BATCH, "0") == "0":
        spark.conf.set(BATCH, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="keystrata-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)  # the driver serves it to all executors
    _shipped[app] = name


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session in this process; settings of an existing session win."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("keystrata")
    base = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one for a local master without that setting.

    On a cluster there must be one: what executors write to a machine's own folder nobody else sees.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        removed_at_end(spark, _local[app])
    return _local[app]


def removed_at_end(spark: SparkSession, folder: str) -> None:
    """Make a folder that the file system removes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the application ends."""
    folder = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    removed_at_end(spark, folder)
    return folder
