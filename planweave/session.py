"""Session helpers: building a local session, reading tables, cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from the caller."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("planweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="planweave-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "planweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory; a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan gives fewer partitions than there are cores.

    Meant for a scan before costly work on each row. A small file is one partition, however dear its rows; a
    large table has more partitions than cores already and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where that setting is missing, and only for a local master: a
    machine-local folder would be lost with an executor, so a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
    own = tempfile.mkdtemp(prefix="planweave-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared folder, for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the copy, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(seen: Observation, seconds: float = 60.0) -> dict | None:
    """What was observed in a job that has ended; null if no word of it comes, as when a busy cluster drops events."""
    got: list[dict] = []
    waiting = threading.Thread(target=lambda: got.append(seen.get), daemon=True)
    waiting.start()
    waiting.join(seconds)
    return got[0] if got else None


def cut_measured(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """As ``cut``, with aggregates over the rows that are taken while they are written, without a job of their own."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    written = df.observe(seen, *measures).checkpoint(eager=True)
    got = measured(seen)
    return written, written.agg(*measures).first().asDict() if got is None else got
