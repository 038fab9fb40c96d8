"""Tables that cut a lineage: written to the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder for one table, that all machines of the session share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; it outlives executors."""
    where = new_folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


class Grown:
    """A table that grows by one folder with each part, so that no part is written twice."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.where, self.parts = spark, schema, new_folder(spark), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a part; returns that part."""
        part = f"{self.where}/part={self.parts}"
        df.write.parquet(part)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.where).select(*self.schema.names)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows
