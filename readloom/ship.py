"""The package's code for executors: they need not have it installed, nor share a folder with the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Hand the package to Spark once an application, which serves it to every executor, late ones too."""
    context = spark.sparkContext
    root = Path(__file__).parent
    if context.applicationId in _SENT or not root.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="readloom-code-"), "readloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix == ".py":
                z.write(p, Path("readloom") / p.relative_to(root))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
