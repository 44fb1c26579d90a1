"""This package on the executors, whose Python workers run the few functions that aren't expressions."""

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application. The archive lies on the driver alone."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenrank_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lumenrank-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lumenrank_shipped = sc.applicationId
