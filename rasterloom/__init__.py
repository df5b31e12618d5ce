"""rasterloom: raster, vector and scene analytics as Spark DataFrame operations."""

import os

__version__ = "0.1.0"


def ship(spark) -> None:
    """Lets Python workers import this package from where the driver has it (which executors must see under the same path;
    elsewhere, install it or hand it out with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
