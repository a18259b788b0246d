"""Zip archives written as files from lines: what a task holds is bounded, and only deflated text moves.

Lines are gathered and deflated where they lie; the pieces go to one task an archive, which streams them into its
file below a folder that all executors share. Tasks import this module, so it imports no part of Spark.
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs

#: Bytes of text that a task holds, of all archives together, before it is deflated; a piece has at most these and a batch.
HELD_BYTES = 32 << 20
PIECES = "source_zip string, place int, crc bigint, deflated binary"
WRITTEN = "source_zip string, zip_bytes bigint"


def pieces_of(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The lines (source_zip, line) of one member as deflated texts of one archive each, a line feed behind every line."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def deflated() -> pa.RecordBatch:
        texts = {source: b"\n".join([*lines, b""]) for source, lines in held.items()}
        columns = [list(texts), [place] * len(texts), [zlib.crc32(t) for t in texts.values()], [zlib.compress(t, 1) for t in texts.values()]]
        kinds = pa.string(), pa.int32(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["source_zip", "place", "crc", "deflated"])

    for batch in batches:
        sources = pc.dictionary_encode(batch["source_zip"])
        for code, source in enumerate(sources.dictionary.to_pylist()):
            lines = pc.filter(batch["line"], pc.equal(sources.indices, code))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")[0].as_py()
            held.setdefault(source, []).append(text)
            size += len(text) + 1
        if size >= HELD_BYTES:
            yield deflated()
            held.clear()
            size = 0
    if held:
        yield deflated()


def _archive(system: fs.FileSystem, path: str, members: list[tuple[str, bytes]], pieces: Iterator[tuple[int, bytes]]) -> int:
    """Write one archive with all of these members (name, header line); pieces come in the order of the members."""
    # Under its name it is whole, whichever attempt of a task wrote it.
    folder, _, name = path.rpartition("/")
    made = f"{folder}/_{name}-{uuid.uuid4().hex}"
    following = next(pieces, None)
    with system.open_output_stream(made) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for place, (member, header) in enumerate(members):
            with archive.open(member, "w", force_zip64=True) as opened:
                opened.write(header + b"\n")
                while following is not None and following[0] == place:
                    opened.write(zlib.decompress(following[1]))
                    following = next(pieces, None)
    system.move(made, path)
    return system.get_file_info(path).size


def archives_of(batches: Iterator[pa.RecordBatch], folder: str, members: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Write an archive with all `members` below `folder` for each source_zip of these pieces, which come in the order of
    source_zip and place (of the member among `members`); the name and size of each."""
    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner)
    rows = (tuple(b[c][i].as_py() for c in ("source_zip", "place", "deflated")) for b in batches for i in range(len(b)))
    for source, pieces in groupby(rows, lambda row: row[0]):
        size = _archive(system, f"{inner}/{source}", members, (row[1:] for row in pieces))
        yield pa.RecordBatch.from_pylist([{"source_zip": source, "zip_bytes": size}])
