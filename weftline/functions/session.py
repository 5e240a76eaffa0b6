"""Session helpers: table access, Python stages, lineage cuts that survive executor loss, and the folder they use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, once an application, unless their path has it already.

    The archive is served to the executors by Spark; nothing is expected to lie on their machines.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.applicationId in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "weftline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def python_stage(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with the package shipped to the workers first, whatever the rows come from."""
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local master without the setting gets a temporary folder. On a cluster a folder of one machine would be read by executors
    that cannot see it, so there the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables, within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/weftline/{spark.sparkContext.applicationId}"


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder on whatever file system holds it; False where there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application. Results read afterwards must have been written or collected before."""
    return remove_folder(spark, scratch_dir(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder unless it already has a checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, the lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a compressed parquet table into the application's scratch folder and read it back.

    Smaller on disk than ``checkpoint`` and lets later scans prune columns. ``release`` deletes these tables.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
