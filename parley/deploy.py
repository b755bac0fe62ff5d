"""Ships this package to executors that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session once; executors fetch them from the driver."""
    if any("/parley-sources-" in p for p in getattr(spark.sparkContext, "_parley_shipped", [])):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="parley-sources-")) / "parley.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("parley") / p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._parley_shipped = [str(path)]
