"""Zip archives as a Spark data source: a partition for each member of each archive, streamed from the file.

No archive is held as one value, so its size has no limit; what a task holds is one batch of lines. The file is
opened where the task runs, by its path, through the file systems that Arrow knows (local and shared disks, HDFS,
S3, GCS). The header of a member comes once, as line 0.
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from io import BufferedReader
from pathlib import PurePosixPath
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of lines in one Arrow batch (but for a longer line), and of one read.
BATCH_BYTES, READ_BYTES = 4 << 20, 1 << 20
LINES = "source_zip string, member string, number bigint, line binary"
FILES = "source_zip string, path string, zip_bytes bigint, zip_sha256 string"
TOPS = "path string, line binary"
#: A row for each member with its header and how many lines follow (no number), and one for each ragged line.
CHECKED = "source_zip string, member string, header binary, lines bigint, number bigint, columns int, fields int"
#: Files whose first lines one task reads.
TOPS_AT_ONCE = 64


def open_file(path: str) -> BinaryIO:
    """A seekable file; Spark's paths write a local file with one slash or three."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def members_of(archive: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """What an archive holds, by file name in small letters without its folders; of two the first."""
    found: dict[str, zipfile.ZipInfo] = {}
    for entry in archive.infolist():
        found.setdefault(PurePosixPath(entry.filename).name.casefold(), entry)
    return found


@contextmanager
def member_stream(file: BinaryIO, path: str, member: str) -> Iterator[BufferedReader]:
    wanted = f"{member}.tsv".casefold()
    with zipfile.ZipFile(file) as archive:
        inside = members_of(archive)
        if wanted not in inside:
            raise FileNotFoundError(f"{path} has no {wanted}")
        with archive.open(inside[wanted]) as opened:
            yield BufferedReader(opened, READ_BYTES)


def lines_of(file: BinaryIO, path: str, member: str, first_only: bool = False) -> Iterator[pa.RecordBatch]:
    """The lines of one member, byte for byte without their ends, in batches of bounded size."""
    source, number = path.rsplit("/", 1)[-1], 0
    with member_stream(file, path, member) as stream:
        while lines := [stream.readline()] if number == 0 else stream.readlines(BATCH_BYTES):
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([source] * n, pa.string()),
                    pa.array([member] * n, pa.string()),
                    pa.array(range(number, number + n), pa.int64()),
                    pa.array([line.rstrip(b"\r\n") for line in lines], pa.binary()),
                ],
                names=["source_zip", "member", "number", "line"],
            )
            number += n
            if first_only:
                return


def checked_lines(file: BinaryIO, path: str, member: str) -> Iterator[pa.RecordBatch]:
    """The lines of one member with more or fewer fields than its header, blank ones included, in batches of bounded
    size, and at last its header and how many lines it has. A tab is a byte of no other character."""
    source, kinds = path.rsplit("/", 1)[-1], (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def told(*rows: tuple) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*((source, member, *row) for row in rows), strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["source_zip", "member", "header", "lines", "number", "columns", "fields"])

    with member_stream(file, path, member) as stream:
        header, number = stream.readline().rstrip(b"\r\n"), 1
        tabs = header.count(b"\t")
        while lines := stream.readlines(BATCH_BYTES):
            ragged = [(n, found) for n, line in enumerate(lines, number) if (found := line.count(b"\t")) != tabs]
            if ragged:
                yield told(*((None, None, n, tabs + 1, found + 1) for n, found in ragged))
            number += len(lines)
    yield told((header, number - 1, None, tabs + 1, None))


def digest_of(file: BinaryIO) -> tuple[int, str]:
    """Bytes and SHA-256 of a whole file, read piece by piece."""
    size, digest = 0, hashlib.sha256()
    while piece := file.read(READ_BYTES):
        size += len(piece)
        digest.update(piece)
    return size, digest.hexdigest()


def first_lines(paths: list[str]) -> Iterator[pa.RecordBatch]:
    """The first line of each file that has one."""
    for path in paths:
        with open_file(path) as file:
            line = BufferedReader(file, 1 << 16).readline()
        if line:
            yield pa.RecordBatch.from_pylist([{"path": path, "line": line.rstrip(b"\r\n")}])


class ArchiveSource(DataSource):
    """Format `filing_archives`. Options: paths (a JSON list), members (a JSON list), part: lines, headers, checked or
    files of archives, or tops, the first lines of plain files."""

    @classmethod
    def name(cls) -> str:
        return "filing_archives"

    def schema(self) -> str:
        return {"files": FILES, "tops": TOPS, "checked": CHECKED}.get(self.options["part"], LINES)

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["part"], json.loads(self.options["paths"]), json.loads(self.options.get("members", "[]")))


class _ArchiveReader(DataSourceReader):
    def __init__(self, part: str, paths: list[str], members: list[str]):
        self.part, self.paths, self.members = part, paths, members

    def partitions(self) -> list[InputPartition]:
        if self.part == "tops":
            groups = [self.paths[i : i + TOPS_AT_ONCE] for i in range(0, len(self.paths), TOPS_AT_ONCE)]
            return [InputPartition((group, "")) for group in groups] or [InputPartition(None)]
        of = [""] if self.part == "files" else self.members
        # A scan of no archive still needs a partition.
        return [InputPartition((path, member)) for path in self.paths for member in of] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, member = partition.value
        if self.part == "tops":
            yield from first_lines(path)
            return
        with open_file(path) as file:
            if self.part == "files":
                size, digest = digest_of(file)
                columns = {"source_zip": path.rsplit("/", 1)[-1], "path": path, "zip_bytes": size, "zip_sha256": digest}
                yield pa.RecordBatch.from_pylist([columns])
            elif self.part == "checked":
                yield from checked_lines(file, path, member)
            else:
                yield from lines_of(file, path, member, self.part == "headers")


def archive_paths(spark: SparkSession, folder: str | list[str], pattern: str = "*", below: bool = False) -> list[str]:
    """The files of a folder (or of all below it); Spark lists them, no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", below)
    return sorted(r["path"] for r in reader.load(folder).select("path").collect())


def read_archives(spark: SparkSession, paths: list[str], part: str, members: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("filing_archives").option("part", part)
    return reader.option("paths", json.dumps(paths)).option("members", json.dumps(members)).load()
