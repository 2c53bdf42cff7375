"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import atexit
import hashlib
import io
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for local use; on a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName("pagemill")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, as a zip that Spark distributes, unless they have it from this session already."""
    context = spark.sparkContext
    if getattr(context, "_pagemill_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(_ROOT.parent))
    name = f"pagemill-{hashlib.sha256(buffer.getvalue()).hexdigest()[:12]}.zip"
    path = Path(tempfile.mkdtemp()) / name  # read by the driver alone, which serves it to the executors
    path.write_bytes(buffer.getvalue())
    context.addPyFile(str(path))
    context._pagemill_shipped = True


def spread(df: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """Rows hashed by keys over at least ``least`` tasks a core, for costly Python stages over few or uneven input files."""
    spark = df.sparkSession
    parts = max(least * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """The same rows read back from the shared checkpoint folder, so that a long plan is not computed again; with ``free`` the shuffle files of that plan are removed as soon as the rows are written. spark.checkpoint.dir names the folder; where it is unset, a local master gets one of its own and any other is an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[[^\]-]*\])?$", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pagemill-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    if not free:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, since a plan has the setting of its time
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def uncut(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing will read again."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
