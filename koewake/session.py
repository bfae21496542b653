"""Session helpers: where intermediate tables go and how the package reaches the executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def build_session(app: str = "koewake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, in local mode only, a folder of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="koewake-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{scratch(spark)}/koewake-{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``materialise`` or ``new_path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The written table outlives any executor. It is deleted when the session's process ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    atexit.register(_quietly_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _quietly_drop(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions; a larger one is left as it is read.

    What comes from a shuffle is left alone: its partitions are known only when it has run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # already imported from a shipped archive
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    place = os.path.join(tempfile.mkdtemp(prefix="koewake-ship-"), "koewake_pkg.zip")
    atexit.register(shutil.rmtree, os.path.dirname(place), True)
    with open(place, "wb") as f:
        f.write(buf.getvalue())
    spark.sparkContext.addPyFile(place)
    _SHIPPED.add(app)
