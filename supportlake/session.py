"""Session helpers.

The library never creates a cluster session behind the user's back: every
transform takes DataFrames.  ``local_session`` is for tests, the bench and
the command line only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings we rely on for plan quality; applied only where the session leaves
# them unset so a cluster's own tuning wins.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "supportlake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SUPPORTLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session names none (tests, a laptop) is a private scratch
    folder set.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="supportlake-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    and read it back: later readers start from files (survives executor loss,
    prunes columns), and the plan is computed a single time (a reliable RDD
    checkpoint would compute it twice: once for the action, once to write).
    """
    import uuid

    root = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(root, "tables", uuid.uuid4().hex)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``supportlake`` importable in Python workers (mapInPandas, pandas
    UDFs, foreachBatch) by adding a zip of the package with ``addPyFile``,
    once per SparkContext.  Clusters that install the package on every node
    do not need it; it is harmless there."""
    import zipfile

    import supportlake

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(supportlake.__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="supportlake-pyfiles-"), "supportlake.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(id(sc))
