"""The session's shared folder and tables written into it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where it is unset
    (local tests) a folder of this machine is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="tidegrid-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The frame as a table written into the shared folder, so that later steps read it instead of
    computing it again, and a lost executor costs no recomputation. As frames that read it may be
    used as long as the session lives, it is deleted when the driver's JVM ends, or by `drop_written`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_paths: list[str] = []


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables written so far; frames that read them can't be used any more. Returns how many there were."""
    n = len(_paths)
    while _paths:
        files, place = _file_system(spark, _paths.pop())
        files.delete(place, True)
    return n
