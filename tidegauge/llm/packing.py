"""Packing token sequences into windows by minimum bin slack.

Every document becomes full windows and one remainder. How many remainders there are of each length is
at most a window's number of counts, whatever the corpus; over these counts the driver plans. The
longest remainder left opens a window, and a subset-sum over bitsets finds the multiset of the others
that fills it closest to capacity; the counts are read back from the bitsets and the pattern is used as
often as they last. Pieces are then numbered within their length and find their window in the plan.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import per_batch, staged

#: Distinct words a worker remembers (one batch may add to them), and the longest of them.
REMEMBERED, LONGEST_WORD = 700_000, 64


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTERS = "a-zªµºß-öø-ÿ"  # lower-case letters of Latin-1
_OTHERS = rf"[^{_LETTERS}\x09-\x0d\x20\x85\xa0']"
#: Runs of letters, and of anything else but white space; a run with an apostrophe takes the letters after it along.
UNITS = re.compile(rf"[{_LETTERS}]+|{_OTHERS}*'(?:{_OTHERS}|')*[{_LETTERS}]*|{_OTHERS}+")


class Encoder:
    """Token ids (as little-endian 32-bit bytes) of whole texts under a tokenizer that lowers its text,
    takes letters apart from the rest and joins nothing across white space. Texts are cut where it
    cuts, and each different unit is encoded once. Only a text of Latin-1 characters without marks of
    special tokens is cut this far, as nothing in it can compose; others are cut at ASCII spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    @staticmethod
    def units(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return re.findall("[^ \t-\r]+", text)
        return re.findall("[^ \t-\r]+", text) if "<|" in text else UNITS.findall(text.lower())

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [self.units(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = list({w: 0 for words in split for w in words if w not in known})
        for i in range(0, len(fresh), 10_000):
            some = fresh[i : i + 10_000]
            found = self.tokenizer.encode_batch(some, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, found, strict=True))
        for words in split:
            yield b"".join(map(known.__getitem__, words))
        for w in fresh:
            if len(w) > LONGEST_WORD:
                del known[w]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    """Once a worker, with the words it has met."""
    return Encoder(path)


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Each row of `docs` (doc_id, text) as pieces: start, length, ids_crc32, doc_tokens, with `part`
    and `number`, the task that cut it and its number there among pieces of its length. A null or empty
    text is its end id alone. With keep_ids the ids come along."""
    more = ", ids array<int>" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            columns: list[list] = [[] for _ in range(8 if keep_ids else 7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    size = len(own) // 4
                    row = [doc_id, start, size, crc32(own), total, part, int(seen[size])]
                    seen[size] += 1
                    for column, value in zip(columns, [*row, np.frombuffer(own, "<i4")] if keep_ids else row, strict=True):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "ids"][: len(columns)]
            types = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, number long{more}"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def closest_fill(counts: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset (length, times) of at most counts[length] items whose sum is the largest up to
    `room`. Bit s of a bitset tells that sum s can be made; longer items come first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + times
            target -= length * times
    return list(used.items())


@dataclass(frozen=True)
class Plan:
    """Entries sorted by (length, first): pieces of a length numbered from `first` on lie `times` to a
    window, from `window` and from offset `place` on."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    window: np.ndarray
    place: np.ndarray
    windows: int


def plan_windows(counts: list[int], capacity: int) -> Plan:
    """Windows for counts[length] pieces of each length up to `capacity`. Each pattern uses up one of
    its lengths, so patterns are bounded by the capacity, not by the corpus."""
    counts, rows, window = list(counts), [], 0
    given = [0] * len(counts)
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            pattern = {longest: 1}
            for length, times in closest_fill(counts, capacity - longest):
                pattern[length] = pattern.get(length, 0) + times
            counts[longest] += 1
            repeats = min(counts[length] // times for length, times in pattern.items())
            place = 0
            for length, times in pattern.items():
                rows.append((length, given[length], times, window, place))
                given[length] += times * repeats
                counts[length] -= times * repeats
                place += length * times
            window += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, window)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text) with sequence_id and offset: windows of at most
    `capacity` ids, filled from offset 0 without a gap. A document is cut only into full windows and a
    remainder. Repeated rows are packed each; ties between pieces of a length go by their place in the
    written table. An empty table has no pieces.

    Shuffled are a few numbers a piece; the driver sees one count a length."""
    pieces = staged(pieces_of(docs, path or tokenizer_path(), end_id, capacity, keep_ids), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    per_part = staged(per_part, "counts")
    counts = [0] * (capacity + 1)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["length"]] = row["n"]
    known = docs.sparkSession.sparkContext.broadcast(plan_windows(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def placed(batch: pa.Array) -> pa.Array:
        plan = known.value
        length, number = (batch.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        entry = np.searchsorted(plan.length << 40 | plan.first, length << 40 | number, side="right") - 1
        turn, slot = np.divmod(number - plan.first[entry], plan.times[entry])
        found = [pa.array(plan.window[entry] + turn), pa.array(plan.place[entry] + slot * length)]
        return pa.StructArray.from_arrays(found, ["sequence_id", "offset"])

    at = per_batch(lambda: placed, "sequence_id long, offset long")(F.struct("length", (F.col("number") + F.col("before")).alias("number")))
    return pieces.join(before, ["length", "part"]).withColumn("at", at).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else [])
    )
