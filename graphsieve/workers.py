"""Makes this package importable in Spark's Python workers where it is not installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def path_for_workers() -> None:
    """Puts the folder of the package on PYTHONPATH, for sessions that are started afterwards on this machine."""
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, known)])


def ship(spark: SparkSession) -> None:
    """Sends the package with the session's jobs, unless workers find it by PYTHONPATH or their working folder anyway."""
    context = spark.sparkContext
    if getattr(context, "_graphsieve_shipped", False):
        return
    context._graphsieve_shipped = True
    known = {os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if os.path.realpath(ROOT) in known:
        return
    folder = tempfile.mkdtemp(prefix="graphsieve-")  # on the driver, which serves the file from there
    atexit.register(shutil.rmtree, folder, True)
    file = f"{folder}/graphsieve.zip"
    with zipfile.ZipFile(file, "w") as out:
        for p in sorted(ROOT.glob("graphsieve/**/*.py")):
            out.write(p, p.relative_to(ROOT))
    context.addPyFile(file)
