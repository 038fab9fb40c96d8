"""What the operators of this subpackage share: the shared folder, written intermediate tables, words and files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and a Python pattern.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir; where that is unset, a local one, but only if
    the session has no other machines."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, where: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()[:1]}
        for where in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def file_system(uri: str):
    """(file system, path) of a URI, for the tasks that read or write files by themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else ("file:" + uri.removeprefix("file:") if uri.startswith("file:") else "file://" + uri))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def written_bytes(df: DataFrame) -> int:
    """The size of a written table's files, as Spark's own plan states it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
