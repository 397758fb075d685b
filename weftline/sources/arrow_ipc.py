"""A Spark data source for Arrow IPC (Feather v2) files: read by file, written one file for each task."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _files(path: str) -> list[str]:
    """The files of a folder on a file system that is mounted on all nodes."""
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".arrow") and not f.startswith(("_", ".")))
    return [path]


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        import pyarrow as pa

        with pa.OSFile(_files(_local(self.options["path"]))[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema):
        return _Reader(_local(self.options["path"]))

    def writer(self, schema, overwrite):
        return _Writer(_local(self.options["path"]), self.options.get("compression", "lz4"))


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p) for p in _files(self.path)]

    def read(self, partition):
        import pyarrow as pa

        with pa.memory_map(partition.path) as f:
            reader = pa.ipc.open_file(f)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)


@dataclass
class _Part(WriterCommitMessage):
    temporary: str
    final: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task writes a hidden file, and files take their names when all tasks are done."""

    def __init__(self, path: str, compression: str):
        self.path, self.compression = path, compression

    def write(self, iterator):
        import pyarrow as pa

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.arrow"
        hidden, rows, writer = os.path.join(self.path, "." + name), 0, None
        options = pa.ipc.IpcWriteOptions(compression=None if self.compression == "none" else self.compression)
        for batch in iterator:
            if writer is None:
                writer = pa.ipc.new_file(hidden, batch.schema, options=options)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
        return _Part(hidden if writer is not None else "", os.path.join(self.path, name), rows)

    def commit(self, messages):
        for m in messages:
            if m and m.temporary:
                os.replace(m.temporary, m.final)

    def abort(self, messages):
        for m in messages:
            if m and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)
