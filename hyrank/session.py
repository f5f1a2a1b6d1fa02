"""Session helpers: sensible defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one Python worker per core already: keep each worker's BLAS single-threaded
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "hyrank", extra: dict | None = None, driver_memory: str | None = "16g") -> SparkSession:
    """Build (or reuse) a session with the defaults this library is tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``hyrank`` importable in Python workers (the --py-files route).

    The batch kernels are pickled by reference to this package, so executors
    need it on their path. The package's source is zipped on the driver once
    per application and handed to ``addPyFile``, which distributes it to every
    executor (including ones started later). Only code goes through this
    driver-side file; no data is ever written to a machine-local folder.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    dest = os.path.join(tempfile.mkdtemp(prefix="hyrank-pyfiles-"), "hyrank.zip")
    with zipfile.ZipFile(dest, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(dest)
    _SHIPPED.add(app)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables and checkpoints.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only when nothing is configured and the master is local
    (tests) a fresh folder under the system temp dir is created and set;
    on a cluster that would be another disk on every machine, so it raises.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="hyrank-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the work folder."""
    base = work_dir(spark).rstrip("/")
    return f"{base}/hyrank/{name}-{uuid.uuid4().hex[:12]}"
