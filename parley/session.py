"""A local session for tests and benchmarks; on a cluster use the session you are given."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parley")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PARLEY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for local runs that set none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parley-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def ship(spark: SparkSession) -> None:
    """Give the workers this package, as `--py-files` would; once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_parley_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="parley-code-"), "parley")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "parley"))
    # The driver's own workers, which prepare stateful processors, get no shipped files.
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [sc.environment.get("PYTHONPATH"), root]))
    sc._parley_shipped = True
