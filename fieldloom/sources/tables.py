"""Tables that cut a plan's past: written once to the shared folder, read by what follows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share; a folder of our own only
    where that is unset and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        named = tempfile.mkdtemp(prefix="fieldloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class Trail:
    """The tables of one computation; all go at the end of the application, or earlier by ``keep``."""

    def __init__(self):
        self.paths: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them again: a lost executor costs a part of one step only."""
        spark = df.sparkSession
        top = f"{shared_folder(spark)}/fields-{spark.sparkContext.applicationId}"
        files, place = _place(spark, top)
        files.mkdirs(place)
        files.deleteOnExit(place)
        path = f"{top}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def keep(self, spark: SparkSession, last: int = 1) -> None:
        """Delete all tables but the last ones."""
        gone, self.paths = self.paths[:-last], self.paths[-last:]
        for path in gone:
            files, place = _place(spark, path)
            files.delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    return Trail().cut(df)
