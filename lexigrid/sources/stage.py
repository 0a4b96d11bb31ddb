"""Tables between the steps of one run, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lexigrid"


class Stages:
    """Written tables cut lineage and survive lost executors; each run has a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/lexigrid/{name}-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing still to be run reads."""
        for t in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(t._stage)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
