"""Session helpers: a local session, the shared folder, shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch_roots: set[str] = set()


def local_session(app: str = "lumenfold", cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LUMENFOLD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; only where nothing is set and all runs on one machine (tests) a
    local one is made. On a cluster without the setting this fails, as a machine's own folder would lose data."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenfold-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: joined by sort and merge, never broadcast on a guess of its size."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; a lost executor costs nothing that was computed before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores (a small file) is dealt to all of them before costly work; a scan
    with enough splits stays as it is, without a shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one folder of this application, which goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/lumenfold-{sc.applicationId}"
    if root not in _scratch_roots:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _scratch_roots.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path before the application ends."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def short_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a statement go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it on any cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or sc.master.startswith("local["):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lumenfold-ship-")) / "lumenfold_ship.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
