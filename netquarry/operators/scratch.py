"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` of the session; it goes when the application ends.

    Where that setting is unset, a session of one machine gets a folder for it; a cluster, whose machines would share nothing, is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="netquarry-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        _own[spark.sparkContext.applicationId] = base
    own = f"{base.rstrip('/')}/netquarry/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return own


#: The most that a table may take, as it lies in shuffles or files, to be sent to all tasks through the driver.
BROADCAST = 256 << 10


def _bytes(text: str) -> int:
    """A size setting such as 10485760b, 256k or -1, as a number of bytes."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}[unit]


@contextlib.contextmanager
def bounded(spark: SparkSession):
    """Settings for jobs over tables that grow. Joins send nothing larger than BROADCAST through the driver, since it takes many times that in memory; and generated code comes
    in methods that the JVM compiles, which it does to 8,000 bytes of bytecode: larger ones would be interpreted for every row."""
    most = {"spark.sql.codegen.hugeMethodLimit": 8000, "spark.sql.autoBroadcastJoinThreshold": BROADCAST, "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST}
    before = {name: spark.conf.get(name, None) for name in most}
    try:
        for name, value in most.items():
            if before[name] is None or _bytes(before[name]) > value:
                spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> str:
    """Writes the frame as Parquet; the path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with bounded(df.sparkSession):
        df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet and read again, so that it is computed once and a lost executor costs nothing before it."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))
