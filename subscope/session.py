"""Session defaults and the staging area for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_roots: dict[str, str] = {}


def session(app: str = "subscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` uses ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors.

    Called before a Python function goes into a plan; does nothing the second time, or
    when the package was itself submitted as an archive.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="subscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "subscope.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def one_process(master: str) -> bool:
    """``local`` and ``local[...]``; the executors of ``local-cluster[...]`` are processes of their own."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{app}"
    if not one_process(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="subscope-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[app] = root
    return f"{_local_roots[app]}/{app}"


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the staging area and read it back.

    Used where several jobs need the same intermediate result: the upstream plan
    runs once, lost executors cost nothing but a re-read, and later passes prune
    columns and take row counts from the file footers.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Stage a small join side and hint its broadcast only if it has at most ``limit`` rows.

    Beyond that the join is left to the optimizer, which shuffles both sides.
    """
    stored = staged(df, label)
    return F.broadcast(stored) if stored.count() <= limit else stored


def clear_stage(spark: SparkSession) -> None:
    """Delete the staged tables of this application; results must have been stored by then."""
    root = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
