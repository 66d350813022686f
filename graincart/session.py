"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "graincart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, unless they find it by PYTHONPATH or the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in (os.path.abspath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p):
        return
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        path = os.path.join(tempfile.mkdtemp(prefix="graincart-"), "graincart.zip")
        atexit.register(shutil.rmtree, os.path.dirname(path), True)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "graincart")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable.

    The folder named in spark.checkpoint.dir wins. Only where it is unset, and only in local mode, a
    temporary folder is taken: on a cluster a machine's own folder would not survive its executor.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graincart-")
        atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read from there, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*tables: DataFrame) -> None:
    """Delete what cut_lineage wrote for `tables`, which nothing reads any more."""
    for df in tables:
        written = df._jdf.queryExecution().logical()
        if written.getClass().getSimpleName() == "LogicalRDD":
            file = written.rdd().getCheckpointFile()
            if file.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Tables up to this many rows are broadcast by hinted().
SMALL = 100_000


def hinted(df: DataFrame, most: int = SMALL, known: int | None = None) -> DataFrame:
    """`df` written out, with a broadcast hint if it has at most `most` rows; beyond, Spark joins it as it likes.

    Where its rows are `known` to be that few at most, it needs neither be written nor counted.
    """
    if known is not None and known <= most:
        return F.broadcast(df)
    written = cut_lineage(df)
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written
