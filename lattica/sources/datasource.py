"""Heap files as a data source: spark.read.format("heaps").load(folder), df.write.format("heaps").save(folder).

A file is a sequence of heaps: a head of eight little-endian 64-bit integers (heap_len, ts, digitiser_id, status,
feng_id, frequency, beam_ants, size of the payload) and the payload. Files are read in parallel, each
in one task; a head that is cut off ends its file, and a payload that is shorter than its head says gives a heap of
the length that is there, which the receive rules then drop. Paths are folders that all executors see as local ones.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEAD = struct.Struct("<8q")
FIELDS = ("heap_len", "ts", "digitiser_id", "status", "feng_id", "frequency", "beam_ants")
SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", payload binary"


def _folder(options: dict) -> str:
    return options["path"].removeprefix("file://")


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".heaps")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            while len(head := f.read(HEAD.size)) == HEAD.size:
                _, *items, size = HEAD.unpack(head)
                payload = f.read(size)
                yield (len(payload), *items, payload)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{uuid.uuid4().hex}.part")
        with open(path, "wb") as f:
            for r in rows:
                payload = bytes(r["payload"] or b"")
                f.write(HEAD.pack(len(payload), *(r[x] or 0 for x in FIELDS[1:]), len(payload)) + payload)
        return _Written(path)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.removesuffix(".part") + ".heaps")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class HeapFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heaps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_folder(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(_folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeapFiles)
