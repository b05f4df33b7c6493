"""Makes this package importable in Python workers wherever the driver runs from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once per application, unless they find it already by PYTHONPATH."""
    app = spark.sparkContext.applicationId
    seen = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _done or _ROOT in seen:
        return
    path = Path(tempfile.mkdtemp(prefix="lexiloom-")) / "lexiloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "lexiloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)
