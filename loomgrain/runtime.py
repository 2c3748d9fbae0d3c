"""Session, shared-folder and staging helpers used by every operator.

Intermediate tables are written to the folder that the cluster names in
``spark.checkpoint.dir``: it is shared by all executors, so a stage that has
been written survives the loss of any of them.  Only where the setting is
absent (tests, notebooks) a folder of our own is chosen.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "loomgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for."""
    b = (
        SparkSession.builder.appName(app)
        .master(master or os.environ.get("SPARK_MASTER", "local[*]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once per application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loomgrain-ship-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"loomgrain-{uuid.uuid4().hex[:12]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("loomgrain", os.path.relpath(full, here)))
    sc.addPyFile(path)


def ship_active() -> None:
    """``ship`` for functions of columns, which know no session."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package, which the workers get beforehand.

    What the workers are given is fixed when Spark wraps the function, so the package has to be shipped by then.
    """
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def pandas_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def grouped(df: DataFrame, *keys: str):
    """``groupBy`` for a function of this package to be applied to."""
    ship(df.sparkSession)
    return df.groupBy(*keys)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Scan one Parquet table of ``sf_dir``; named columns only, if given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """The run's own folder below ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="loomgrain-")
            sc.setCheckpointDir(base)
        root = _roots[sc.applicationId] = f"{base.rstrip('/')}/loomgrain-{sc.applicationId}"
        atexit.register(_drop, spark, root)
    return _roots[sc.applicationId]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the run's folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, fixes the placement of rows in partitions (so that
    several passes see the same ranges) and evaluates ``df`` once.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``staged`` wrote in this session; frames read from it end with it."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        _drop(spark, root)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    For narrow tables of keys and numbers; the check is a job over ``df``, so
    hand over a staged table or a cheap aggregate.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
