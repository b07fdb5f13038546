"""Makes this package importable on the executors of a session that was started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import folio

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, once an application.

    Not needed, and not done, where the workers find it themselves: it is on PYTHONPATH, or
    the session runs in the folder that holds it.
    """
    root, sc = Path(folio.__file__).resolve().parent.parent, spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _DONE or root in paths or Path.cwd().resolve() == root:
        return
    target = Path(tempfile.mkdtemp(prefix="folio-")) / "folio.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "folio").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    _DONE.add(sc.applicationId)
