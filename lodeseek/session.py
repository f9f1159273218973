"""Sessions, and shipping this package to executors that do not have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, name: str = "lodeseek") -> SparkSession:
    """A local session as tests and the benchmark use it; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESEEK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share (``spark.checkpoint.dir``); it goes when the
    application ends.  Only a local session may have none: it gets a temporary one."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="lodeseek-")
        base = _own_folders[app]
    folder = f"{base.rstrip('/')}/lodeseek-{app}"
    if folder not in _going:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _going.add(folder)
    return folder


_going: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, f"{package.name}/{file.relative_to(package)}")
    folder = tempfile.mkdtemp(prefix="lodeseek-ship-")
    path = os.path.join(folder, "lodeseek.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
