"""Makes the package importable on executors."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark application. Spark's own file server hands it out, so no folder need be shared."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if not name.endswith(".pyc"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    # The driver's file server reads it for as long as the application lives; Spark deletes this folder at the end.
    path = os.path.join(sc._temp_dir, "quillspark_package.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._quillspark_shipped = True
