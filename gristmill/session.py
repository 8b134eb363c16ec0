"""Session helpers: the package for Python workers that don't share the driver's path."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, once a context, unless PYTHONPATH already has it."""
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir() or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="gristmill-ship-")) / "gristmill_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "gristmill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    keep = list(sys.path)
    sc.addPyFile(str(at))
    sys.path[:] = keep
    sc._gristmill_shipped = True
