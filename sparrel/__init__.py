"""A PySpark engine that builds, audits and evaluates labelled relation datasets."""

from __future__ import annotations

import os


def findable(spark):
    """The session; in local mode its Python workers now find this package whatever the working directory is (clusters get it with the job)."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        context.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark
