"""Session defaults and the few helpers that touch cluster resources."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ceiling, in rows, of anything the library broadcasts on purpose.
BROADCAST_ROWS = 200_000


def session(app: str = "stepweave", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster, bring your own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``.

    Without that setting a local master gets a temporary folder, as in tests;
    on a cluster it is an error, since executors share no temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not one_machine(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "stepweave-checkpoints"))


def one_machine(master: str) -> bool:
    """Do driver and tasks share one process? ``local`` and ``local[n]``, but not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    Used where a result feeds several branches: recomputing would repeat a
    shuffle, and files in shared storage survive the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a parquet table in the checkpoint folder: compressed, and each reader takes only its columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Beyond that the frame comes back unhinted, and the join shuffles.
    The count stops at ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, so that workers need no installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "stepweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
