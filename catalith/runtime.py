"""Session, table access and lineage cutting shared by every module."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "catalith", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once, so that it need not be installed on the executors.

    The driver's file server hands the archive out; only the driver reads it from its folder.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_catalith_shipped", False):
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="catalith-"), "catalith_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, Path(root.name) / source.relative_to(root))
        sc.addPyFile(archive)
        sc._catalith_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; make a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            named = os.path.join(tempfile.gettempdir(), f"catalith-checkpoint-{os.getpid()}")
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, with a plain message, when a needed column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
