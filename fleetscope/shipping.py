"""Makes this package importable for Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to Spark's file server, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # a package that itself came from a zip is there already
        folder = tempfile.mkdtemp(prefix="fleetscope-ship-")
        name = os.path.join(folder, "fleetscope_package.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def arrow_schema(ddl: str) -> pa.Schema:
    """A schema string for Arrow; made on the driver, for its workers."""
    return to_arrow_schema(StructType.fromDDL(ddl))
