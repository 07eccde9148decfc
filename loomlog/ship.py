"""Sends the package to executors that can't import it from a path of their own."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """As --py-files would; nothing to do where Python workers start in the repository or have it in PYTHONPATH."""
    here = {os.path.realpath(x) for x in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] if x}
    if str(ROOT) in here or spark.sparkContext.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "loomlog.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted((ROOT / "loomlog").rglob("*.py")):
            out.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(spark.sparkContext.applicationId)
