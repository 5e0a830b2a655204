"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once in an application, unless their Python path has it by inheritance."""
    root = Path(__file__).resolve().parent.parent
    paths = [os.path.realpath(p or ".") for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    app = spark.sparkContext.applicationId
    if str(root) in paths or app in _SHIPPED:
        return
    at = Path(tempfile.mkdtemp(), "annolyte.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(Path(root, "annolyte").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)
