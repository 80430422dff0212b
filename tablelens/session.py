"""Session helpers.

On a cluster the session is given; ``get_session`` only fills settings that
are unset, so a cluster's own ``spark.checkpoint.dir`` and partition sizing
always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # wide fused aggregates (one per table) keep whole-stage codegen
    "spark.sql.codegen.maxFields": "1000",
}


_SHIPPED: set[str] = set()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tablelens") -> SparkSession:
    """Return the active session, or build one; settings given from outside are left alone.

    A master, driver memory or checkpoint folder that spark-submit or the defaults file
    has set wins. Without a master a local one is taken, and only a local master
    gets a scratch checkpoint folder.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    # started by spark-submit or with its arguments: master and memory are settled there
    submitted = bool(os.environ.get("PYSPARK_GATEWAY_PORT") or os.environ.get("PYSPARK_SUBMIT_ARGS"))
    if master or not submitted:
        builder = builder.master(master or os.environ.get("TABLELENS_MASTER", "local[8]"))
    if not submitted:
        for key, value in {**_DEFAULTS, "spark.driver.memory": os.environ.get("TABLELENS_DRIVER_MEM", "16g")}.items():
            builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in _DEFAULTS.items() if submitted else ():
        if key.startswith("spark.sql.") and not given.contains(key):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once an application), so that they need no installation."""
    import shutil
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tablelens-code-")
    archive = shutil.make_archive(os.path.join(folder, "tablelens"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


#: bytes of an Arrow batch that goes to a Python worker in queries on whole texts (Spark's own bound is 64 MB)
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, where the session hasn't set a bound: 10,000 whole texts are too much for each of an executor's workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a scratch folder; any other master raises,
    because executors couldn't see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def written(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: lineage ends there."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
