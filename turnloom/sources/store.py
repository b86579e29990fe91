"""Derived inputs, written once: a table in the shared folder, read by every query of the application that needs it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str, str], str] = {}
_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; on a local master, where it is unset, a folder of our own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="turnloom-"))


def written(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a Parquet table of the application, made at the first call."""
    at = (spark.sparkContext.applicationId, name, sf_dir)
    if at not in _written:
        path = f"{folder(spark)}/turnloom-inputs/{name}-{len(_written)}-{abs(hash(at)):x}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _written[at] = path
    return spark.read.parquet(_written[at])
