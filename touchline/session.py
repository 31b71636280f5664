"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a session gets when this package creates it. On a cluster the
#: submitter's own values win: nothing here is forced on a running session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_FOLDERS: set[str] = set()


def get_session(master: str = "local[*]", app: str = "touchline", **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session that names none, which happens in local tests, gets a
    temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"touchline-{os.getpid()}")
    sc.setCheckpointDir(own)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one, removed at its end."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/touchline-{spark.sparkContext.applicationId}"
    if root not in _FOLDERS:
        _FOLDERS.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        if folder.startswith(("/", "file:")):
            shutil.rmtree(re.sub(r"^file:/*", "/", folder), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan starts again at the table, so an executor's loss costs no more than
    the tasks that ran on it. A written table is compressed by column; it is
    several times smaller than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def release(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more; the
    rounds of an iteration would else lie there until the application ends."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        _remove(df.sparkSession, path)


def scale_partitions(spark: SparkSession, floor: int = 1) -> int:
    """Number of shuffle partitions of the session, at least ``floor``."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Every operator with a Python stage calls it, so a job needs no set-up of
    the workers' import path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_touchline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="touchline-")) / "touchline.zip"
    atexit.register(shutil.rmtree, target.parent, True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._touchline_shipped = True
