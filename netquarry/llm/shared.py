"""Tables that cut a job's lineage, in the application's folder that all machines of the cluster share; they go when the application ends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import folder


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: a lost executor costs no recomputation before it.

    by: a column of few values by which the table is partitioned."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a stored frame's files. Only for frames that nothing lazy reads any more: what was made of them is stored itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def thinned(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About 8 * most rows, those whose key's hash is below a bound that the number of rows sets (all, where they are fewer): a bounded
    sample to order and cut, so that no task has to send its own ``most`` rows."""
    n = df.count()
    return df if n <= 8 * most else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * 8 * most / n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
