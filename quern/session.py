"""Making the package known to the workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a context, unless their path has it: they import functions by name."""
    context = spark.sparkContext
    here = {os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p}
    if context.applicationId in _SHIPPED or str(ROOT.resolve()) in here:
        return
    with tempfile.NamedTemporaryFile(prefix="quern-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((ROOT / "quern").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(f.name)  # Spark serves it; executors need no shared folder
    _SHIPPED.add(context.applicationId)
