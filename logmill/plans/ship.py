"""The package itself on the executors, wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once an application.

    Python workers import what the functions they run refer to. They need not share the driver's path or working
    folder; Spark serves the archive from the driver. A package that lies in an archive already was shipped with it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or not PACKAGE.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="logmill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
