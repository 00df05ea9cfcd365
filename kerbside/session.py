"""Sessions, and this package's code on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "kerbside", **config: str) -> SparkSession:
    """A session with the settings that the operators count on: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    return builder.config(map=defaults | config).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as --py-files would; once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(_own_folder("kerbside-"))
    with zipfile.ZipFile(folder / "kerbside.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(folder / "kerbside.zip"))
    _shipped.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder, spark.checkpoint.dir; a folder of our own only in local mode, as in tests, and until the end."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(shared or _own_folder("kerbside-checkpoints-"))


def _own_folder(prefix: str) -> str:
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
