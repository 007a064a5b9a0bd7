"""Sessions, and this package on the executors."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch between the JVM and Python: documents are long, and both sides hold whole batches.
BATCH_KEY, BATCH_ROWS, SPARK_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"

_shipped: weakref.WeakSet = weakref.WeakSet()


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the settings that the queries assume; a cluster's own settings win where they are given."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(app)
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shipped(f):
    """A function of the package for use in Python tasks; where a session is active, the package is sent to its executors."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return f


def spread(df: DataFrame) -> DataFrame:
    """The rows of a stored table over all cores; a table that comes in as many splits as there are cores is left as it is.
    Only for scans: for other plans, asking for the number of partitions would run them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a context, so that Python tasks can import it wherever they run.
    Where the session has Spark's default batch size, batches are made smaller."""
    if spark.conf.get(BATCH_KEY, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc)
