"""Keyed tables that micro-batches change: versioned buckets of keys, each batch applied exactly once.

A table is a folder of Parquet files, one sub-folder for each batch and bucket, and a manifest for each batch that says which
batch holds each bucket's current rows. A batch reads and rewrites only the buckets its keys fall into and then
publishes its manifest by one rename. A batch whose manifest exists is done: repeating it changes nothing. What a
killed batch left without a manifest is overwritten when it is repeated, and never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class KeyedTable:
    """Rows by key at `path`, a folder that driver and executors share. order says which of a key's rows is the latest."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), list(key), list(order), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def batches(self) -> list[int]:
        """Numbers of the batches that are done."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def manifest(self, batch: int | None = None) -> dict[int, int]:
        """bucket -> the batch with its rows, as of a batch or the last one."""
        done = self.batches()
        batch = (done[-1] if done else None) if batch is None else batch
        if batch is None:
            return {}
        stream = self._fs.open(self._at(f"manifests/{batch:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def _publish(self, batch: int, manifest: dict[int, int]) -> None:
        draft, final = self._at(f"drafts/{batch:012d}.json"), self._at(f"manifests/{batch:012d}.json")
        self._fs.mkdirs(self._at("manifests"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"can't publish {final.toString()}")

    def _rows(self, manifest: dict[int, int], buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/batch={b}/bucket={k}" for k, b in manifest.items() if buckets is None or k in buckets]
        paths = [p for p in paths if self._fs.exists(self._hadoop.Path(p))]  # a bucket that lost its last row has no files
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, batch: int | None = None) -> DataFrame:
        """The table after the last batch, or after an earlier one."""
        return self._rows(self.manifest(batch))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, changes: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> bool:
        """Applies a batch: by default the latest row of each key stays. False if it was done before.

        merge(current, changes) gets the rows of the touched buckets and gives their new ones, of the same keys only.
        """
        if batch in self.batches():
            return False
        changes = changes.select(*self.schema.names)
        touched = [r[0] for r in changes.select(self.bucket()).distinct().collect()]  # `buckets` at most
        manifest = self.manifest()
        current = self._rows(manifest, touched)
        rows = (merge or self.latest)(current, changes).select(*self.schema.names)
        rows.withColumn("bucket", self.bucket()).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        self._publish(batch, manifest | dict.fromkeys(touched, batch))
        return True

    def latest(self, current: DataFrame, changes: DataFrame) -> DataFrame:
        """One row of each key, the last by order; of equals the changed one."""
        both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
        rest = [c for c in self.schema.names if c not in self.key]
        best = F.max_by(F.struct(*rest), F.struct(*self.order, "_new"))
        return both.groupBy(*self.key).agg(best.alias("_row")).select(*self.key, "_row.*")

    def forget(self, keep: int = 2) -> None:
        """Deletes the files that none of the last `keep` batches needs."""
        done = self.batches()
        held = {(k, b) for n in done[-keep:] for k, b in self.manifest(n).items()}
        for n in done[:-keep]:
            folder = self._at(f"data/batch={n}")
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                name = f.getPath().getName()
                if name.startswith("bucket=") and (int(name[7:]), n) not in held:
                    self._fs.delete(f.getPath(), True)
            self._fs.delete(self._at(f"manifests/{n:012d}.json"), False)


def carry_over(oldest: Column, source: str = "source", ts: str = "ts") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge by which sources that sent something are replaced and silent ones keep their rows younger than `oldest`.

    The table's key must be the source, so that a bucket holds all rows of its sources.
    """

    def merge(current: DataFrame, changes: DataFrame) -> DataFrame:
        silent = current.join(changes.select(source).distinct(), source, "left_anti").filter(F.col(ts) > oldest)
        return changes.unionByName(silent)

    return merge
