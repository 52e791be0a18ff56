"""Session plumbing shared by all operators that run Python on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, unless their Python path has it already."""
    here = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(here.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{here.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
