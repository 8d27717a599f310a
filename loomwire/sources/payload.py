"""A sink that publishes rows, source statistics and trends as one snapshot, whole or not at all.

Tasks write their sections as JSON lines below a folder of the attempt; the commit names that folder in the file CURRENT by one
rename. Readers follow CURRENT, so they see the old snapshot until the new one is complete. An aborted write is never read; what
late tasks of it leave goes with the next snapshot. One writer publishes at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .sinks import light

CURRENT = "CURRENT"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sections(**tables: DataFrame) -> DataFrame:
    """section, record: the rows of all tables as JSON, each named by its keyword; heavy columns are left out."""
    out = None
    for name, table in tables.items():
        one = light(table).select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("record"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # section, file, rows


class SnapshotSink(DataSource):
    """Writer `snapshot` for (section, record) to option `path`, a URI."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return "section string, record string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SnapshotWriter(self.options["path"])


class _SnapshotWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri, self.attempt = uri, f"snapshot-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        system, root = _file_system(self.uri)
        open_, files, name = {}, {}, uuid.uuid4().hex
        try:
            for row in iterator:
                if row.section not in open_:
                    system.create_dir(f"{root}/{self.attempt}/{row.section}", recursive=True)
                    open_[row.section] = system.open_output_stream(f"{root}/{self.attempt}/{row.section}/{name}.json")
                    files[row.section] = 0
                open_[row.section].write(row.record.encode() + b"\n")
                files[row.section] += 1
        finally:
            for f in open_.values():
                f.close()
        return _Written([(s, f"{name}.json", n) for s, n in files.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        """The files of the tasks that count, by section; files of tasks that were repeated are in no list."""
        system, root = _file_system(self.uri)
        listed: dict[str, dict[str, int]] = {}
        for m in messages:
            for section, file, n in m.files if m else ():
                listed.setdefault(section, {})[file] = n
        system.create_dir(root, recursive=True)
        before = current(self.uri)
        with system.open_output_stream(f"{root}/{self.attempt}.draft") as f:
            f.write(json.dumps({"folder": self.attempt, "sections": listed}).encode())
        system.move(f"{root}/{self.attempt}.draft", f"{root}/{CURRENT}")
        self._tidy({self.attempt, before["folder"]} if before else {self.attempt})

    def _tidy(self, keep: set[str]) -> None:
        """Deletes the folders of older snapshots and of attempts that failed; readers may still be in the one before."""
        from pyarrow import fs

        system, root = _file_system(self.uri)
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.type == fs.FileType.Directory and f.base_name.startswith("snapshot-") and f.base_name not in keep:
                system.delete_dir(f.path)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, root = _file_system(self.uri)
        if system.get_file_info(f"{root}/{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.attempt}")


def publish(uri: str, **tables: DataFrame) -> None:
    """Writes the tables as one snapshot at uri."""
    spark = next(iter(tables.values())).sparkSession
    spark.dataSource.register(SnapshotSink)
    sections(**tables).write.format("snapshot").mode("append").option("path", uri).save()


def current(uri: str) -> dict | None:
    """What CURRENT says: folder, and rows by section and file; None where nothing was published."""
    system, root = _file_system(uri)
    try:
        with system.open_input_stream(f"{root}/{CURRENT}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def read(spark: SparkSession, uri: str, section: str, schema) -> DataFrame:
    """A section of the published snapshot; empty where there is none."""
    now = current(uri)
    files = (now or {"sections": {}})["sections"].get(section, {})
    return spark.read.schema(schema).json([f"{uri}/{now['folder']}/{section}/{f}" for f in files]) if files else spark.createDataFrame([], schema)
