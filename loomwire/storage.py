"""Reading tables and writing intermediate ones to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Largest table, in rows, that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: And in bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Where none is set, a temporary one on a local master, as in tests; on a cluster that is an error, since the
    driver's own folder is not the executors'.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomwire-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, has sizes Catalyst can plan with."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def row_bytes(schema: StructType) -> int:
    """About how many bytes a row takes in a broadcast table; variable fields by what ids and short lists take."""
    size = 64
    for f in schema.fields:
        kind = f.dataType
        size += row_bytes(kind) if isinstance(kind, StructType) else 1024 if isinstance(kind, (ArrayType, MapType)) else 64 if isinstance(kind, (StringType, BinaryType)) else 8
    return size


def bounded(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its count and the width of its rows prove it small; else as it is, so that the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most and n * row_bytes(df.schema) <= BROADCAST_BYTES else df
