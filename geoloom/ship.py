"""Brings the package to executors that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: add the package's modules to it, unless workers on this machine find them by PYTHONPATH or their working folder.

    Spark serves the archive to every executor, those that join later included.
    """
    sc = spark.sparkContext
    here = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT
    if sc.applicationId in _done or (here and sc.master.startswith("local")):
        return
    place = Path(tempfile.mkdtemp(prefix="geoloom-")) / "geoloom.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*ROOT.glob("geoloom/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(place))
    _done.add(sc.applicationId)
