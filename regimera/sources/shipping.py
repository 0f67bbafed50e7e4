"""Makes the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the context's Python files, once."""
    context = spark.sparkContext
    if getattr(context, "_regimera_core_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    target = Path(tempfile.mkdtemp(prefix="regimera-core-")) / "regimera_core.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._regimera_core_shipped = True
