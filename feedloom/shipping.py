"""Makes the package importable in Python workers on other machines."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application; without effect in repeated calls."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="feedloom-", suffix=".zip", delete=False) as target:
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(target.name)
    atexit.register(Path(target.name).unlink, True)  # executors that start later fetch it from the driver
    _SENT.add(context.applicationId)
