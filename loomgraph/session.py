"""Session helpers: a local session for tests and benches, the package on the workers, and the
shared folder for reliable checkpoints."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application.  The zip goes
    through Spark's own file distribution, so it reaches executors on other machines."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-ship-"), "loomgraph_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    sc._loomgraph_shipped = True


def shared_dir(spark: SparkSession) -> None:
    """Sets a checkpoint folder only where the session names none, which is for a single machine."""
    if spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    elif not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files, and where it is set to the checkpoints, of results that nothing refers to any
    more, which it notices only when the driver's memory is collected."""
    for _ in range(3):  # one collection frees what the next one finds unreferenced
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
