"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int | str = 8) -> SparkSession:
    """A local session as tests and the bench use it; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``.  Only a local session without one, as in tests, uses a
    scratch folder; elsewhere its lack is an error, as executors share no scratch folder.
    """
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, marked to be broadcast only if it has ``most`` rows of a few plain columns or fewer; counting them reads it once.

    Larger ones are joined as Spark sees fit.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandwise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / "strandwise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._strandwise_shipped = True
