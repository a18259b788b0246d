"""Repeated passages by suffix arrays: each byte goes that lies in a 50-byte string which also starts in an earlier document.

A suffix array of a whole corpus fits no task, so texts are first dealt by content. Every 50-byte string has a
key, the least hash of its 31 strings of 20 bytes; it depends on nothing else, so equal strings meet. Strings
that follow each other under one key are one piece of text. Only pieces whose key two documents share can hold a
repeat; these go, sorted by key, into blocks of bounded size. A block's Burrows-Wheeler transform gives the
common prefixes of neighbouring suffixes breadth first: all of length 0, then by extending backwards those of
1, 2 and so on, up to 49. What no step has parted by then agrees in 50 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import staged

SPAN, MARK = 50, 20
_WINDOW = SPAN - MARK + 1
#: Bytes hashed at once, starts of one piece, bytes of one block of suffixes.
CHUNK, LONGEST, BLOCK = 1 << 17, 4096, 1 << 18
#: Documents that may share a key before its pieces are dealt by each 50-byte string instead.
CROWD = 1 << 16
#: Documents of one batch that show a key to others; they prove that it is shared. More of them are dealt out.
SHOWN, DEALT = 2, 1 << 16
#: Pieces a task remembers so as not to send a text twice.
REMEMBERED = 1 << 18
_draw = np.random.default_rng(SPAN)
_BYTES = _draw.integers(0, 2**64, 256, np.uint64)
_TURN = [int(_draw.integers(0, 2**64, dtype=np.uint64)) | 1]
for _ in range(5):
    _TURN.append(_TURN[-1] * _TURN[-1] % 2**64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The bits of a least hash that make a key. Keys are moved most of all; two strings that share one by chance only meet.
KEPT = np.uint64((1 << 40) - 1)


def _least_hashes(part: np.ndarray) -> np.ndarray:
    """The key of the string of 50 bytes at each position of `part`."""
    hashes = {1: _BYTES[part]}
    for step, size in enumerate((1, 2, 4, 8)):
        h = hashes[size]
        hashes[2 * size] = h[:-size] * np.uint64(_TURN[step]) + h[size:]
    h = hashes[16][: len(part) - MARK + 1] * np.uint64(_TURN[2]) + hashes[4][16:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    for size in (1, 2, 4, 8):
        h = np.minimum(h[:-size], h[size:])
    return np.minimum(h[: 16 - _WINDOW], h[_WINDOW - 16 :])


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of some texts: which text, start, number of 50-byte strings, key. Each string lies in one
    piece. Short texts are hashed together, long ones in chunks."""
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - SPAN + 1, CHUNK):
            part = text[at : at + CHUNK + SPAN - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= CHUNK:
                found.append(_pieces_of_group(group))
                group, held = [], 0
    if group:
        found.append(_pieces_of_group(group))
    which, start, count, key = (np.concatenate(c) for c in zip(*found, strict=True))
    return which, start, count, (key & KEPT).view(np.int64)


def _pieces_of_group(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    least = _least_hashes(np.frombuffer(b"".join(part for _, _, part in group), np.uint8))
    size = np.array([len(part) for _, _, part in group])
    head = np.cumsum(size) - size
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[::LONGEST] = True
    new[head] = True
    # Strings over the border of two texts are in neither: the last of a text ends with it.
    stop = np.append(head[1:] - SPAN + 1, len(least))
    new[stop[:-1]] = True
    first = np.flatnonzero(new)
    of = np.searchsorted(head, first, side="right") - 1
    inside = first < stop[of]
    count = np.diff(first, append=len(least))[inside]
    first, of = first[inside], of[inside]
    which, offset = (np.array([g[i] for g in group], np.int64) for i in (0, 1))
    return which[of], first - head[of] + offset[of], count, least[first]


def shared_keys(docs: DataFrame) -> DataFrame:
    """key, doc_id: the keys of a document that another doc_id has too. Of a batch's documents with one key,
    two show it to the others; the rest know by then that it is shared, and are dealt out, so that a key of a
    third of all rows stays spread."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, _, _, keys = pieces_of(batch["text"].to_pylist())
            owners = batch["doc_id"].to_numpy()[which]
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])[: len(keys)]
            keys, owners = keys[new], owners[new]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            nth = np.arange(len(keys)) - np.repeat(first, np.diff(first, append=len(keys)))
            share = np.where(nth < SHOWN, 0, 1 + (owners % DEALT)).astype(np.int32)
            # Rows of one document follow each other, which shuffles compress better.
            order = np.argsort(owners, kind="stable")
            keys, owners, share = keys[order], owners[order], share[order]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners), pa.array(share)], names=["key", "doc_id", "share"])

    long = docs.where((F.octet_length("text") >= SPAN) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = long.mapInArrow(marked, "key long, doc_id long, share int")
    group = Window.partitionBy("key", "share")
    seen = rows.withColumn("least", F.min("doc_id").over(group)).withColumn("most", F.max("doc_id").over(group))
    return seen.where("share > 0 or least < most").select("key", "doc_id")


def _of_text(text: bytes) -> int:
    """A number that tells texts of one doc_id apart (two agree with a probability of 2 to the power of -32)."""
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def _name(piece: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(piece), "big", signed=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of texts whose keys are listed: where each lies, and its text the first time a task meets it
    (or meets it in an earlier document). Pieces of a crowded key are cut into single strings with keys of their own."""
    known: dict[int, int] = {}
    for batch in batches:
        texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
        which, start, count, key = pieces_of(texts)
        # What one text's list says of a key holds for all.
        wanted = np.isin(key, batch["keys"].flatten().to_numpy())
        which, start, count, key = which[wanted], start[wanted], count[wanted], key[wanted]
        alone = np.isin(key, batch["crowded"].flatten().to_numpy())
        times = np.where(alone, count, 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        which, start, key = np.repeat(which, times), np.repeat(start, times) + nth, np.repeat(key, times)
        finish = start + np.where(np.repeat(alone, times), 1, np.repeat(count, times)) + SPAN - 1
        names, pieces = [], []
        for i, a, b in zip(which.tolist(), start.tolist(), finish.tolist(), strict=True):
            piece, doc = texts[i][a:b], ids[i]
            name = _name(piece)
            names.append(name)
            if known.get(name, doc + 1) > doc:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[name] = doc
                pieces.append(piece)
            else:
                pieces.append(None)
        named = np.array(names, np.int64)
        keys = np.where(np.repeat(alone, times), named, key)
        of_text = np.array([_of_text(t) for t in texts], np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids, np.int64)[which]), pa.array(of_text[which]), pa.array(start), pa.array(named), pa.array(keys), pa.array(pieces, pa.binary())],
            names=["doc_id", "of_text", "at", "name", "key", "piece"],
        )


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of `text` sorted by the 64 bytes from each on: by 8 bytes, then three times those that tie by
    the ranks of what follows, which doubles the length."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    value = np.zeros(n, np.uint64)
    for i in range(8):
        value = (value << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(value)
    value = value[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    rank = np.empty(n + 64, np.int64)
    rank[n:] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    for size in (8, 16, 32):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        value = rank[at] * (n + 1) + rank[at + size] + 1
        by = np.argsort(value)
        order[tied], value = at[by], value[by]
        new[tied[1:]] |= value[1:] != value[:-1]
        first = np.concatenate([[True], value[1:] != value[:-1]])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
    return order


def parted(text: np.ndarray, order: np.ndarray, least: int = SPAN) -> np.ndarray:
    """Whether each suffix, in order, shares fewer than `least` bytes with the one before it."""
    before = text[order - 1]  # the Burrows-Wheeler transform
    back = np.argsort(before, kind="stable").astype(np.int32)  # row of a suffix less its first byte: rows of one byte keep their order
    first = text[order]
    cut = np.concatenate([[True], first[1:] != first[:-1]])
    still = np.flatnonzero(~cut)
    lower, upper, new = back[still - 1], back[still], cut.copy()
    for _ in range(1, least):
        # Rows with one byte in front of two groups that the last step parted are parted now.
        groups = np.cumsum(new, dtype=np.int32)
        hit = groups[lower] != groups[upper]
        if not hit.any():
            break
        new[:] = False
        new[still[hit]] = True
        cut |= new
        still, lower, upper = still[~hit], lower[~hit], upper[~hit]
    return cut


def _first_docs(names: list[int], docs: list[int], pieces: list[bytes]) -> pa.RecordBatch:
    """Of one block: for each piece the runs of its 50-byte strings with the smallest doc_id that has them."""
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no byte of UTF-8
    size = np.array([len(p) for p in pieces])
    start = np.cumsum(size + 1) - size - 1
    which = np.repeat(np.arange(len(pieces)), size + 1)
    whole = np.arange(len(text)) - start[which] <= size[which] - SPAN
    order = suffix_order(text)
    groups = np.flatnonzero(parted(text, order))
    doc = np.array(docs, np.int64)[which]
    doc[~whole] = np.iinfo(np.int64).max
    least = np.minimum.reduceat(doc[order], groups)
    first = np.empty(len(text), np.int64)
    first[order] = np.repeat(least, np.diff(groups, append=len(text)))
    at = np.flatnonzero(whole)
    new = np.concatenate([[True], (first[at[1:]] != first[at[:-1]]) | (which[at[1:]] != which[at[:-1]])])
    runs = np.flatnonzero(new)
    head = at[runs]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(names, np.int64)[which[head]]), pa.array(head - start[which[head]]), pa.array(np.diff(runs, append=len(at))), pa.array(first[head])],
        names=["name", "start", "count", "first"],
    )


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole keys from rows (key, doc_id, piece) sorted by key."""
    block: dict[int, list] = {}
    held, last = 0, None
    for batch in batches:
        for key, doc, piece in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "piece")), strict=True):
            if held >= BLOCK and key != last:
                yield _first_docs(list(block), [d for d, _ in block.values()], [p for _, p in block.values()])
                block, held = {}, 0
            last, name = key, _name(piece)
            if name in block:
                block[name][0] = min(block[name][0], doc)
            else:
                block[name] = [doc, piece]
                held += len(piece)
    if block:
        yield _first_docs(list(block), [d for d, _ in block.values()], [p for _, p in block.values()])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            of_text = _of_text(text)
            gone = np.zeros(len(text) + 1, np.int32)
            for s in spans:
                if s["of_text"] == of_text:
                    gone[s["start"]] += 1
                    gone[s["finish"]] -= 1
            inside = np.cumsum(gone[:-1]) > 0
            n_spans = int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())
            kept = np.frombuffer(text, np.uint8)[~inside].tobytes()
            out.append((doc, hashlib.sha256(text).digest(), int(inside.sum()), n_spans, kept))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "digest", "n_removed", "n_spans", "kept"])


def without_repeats(spark: SparkSession, docs: DataFrame, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with `kept`) the bytes left, for every row of
    `docs` (doc_id long, text; other columns are not read).

    A null text is empty. A null doc_id is neither before nor after another: such a row keeps all its bytes
    and takes none. Rows that repeat a doc_id take nothing from each other. A text that an earlier document has
    whole goes whole, if it has 50 bytes, and only the earliest is searched."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = staged(texts.select("doc_id", F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")), "rows")
    heads = rows.where(F.col("n_bytes") >= SPAN).groupBy("digest").agg(F.min("doc_id").alias("earliest"))
    shared = staged(shared_keys(texts), "shared")
    crowds = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key", F.lit(True).alias("crowd"))
    firsts = heads.select(F.col("earliest").alias("doc_id")).distinct()
    listed = (
        shared.join(crowds, "key", "left")
        .join(firsts, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("crowd"), F.col("key"))).alias("crowded"))
    )
    listed = staged(listed, "listed")
    cut = texts.join(listed, "doc_id").mapInArrow(_cut, "doc_id long, of_text int, at long, name long, key long, piece binary")
    found = cut.where("piece is not null").select("key", "doc_id", "piece").repartition("key").sortWithinPartitions("key")
    # Written, so that the pieces are gone from the disk before what is known of them is joined.
    firsts_of = staged(found.mapInArrow(_repeats, "name long, start long, count long, first long"), "firsts")
    spans = (
        cut.select("name", "doc_id", "of_text", "at")
        .join(firsts_of, "name")
        .where(F.col("first") < F.col("doc_id"))
        .select("doc_id", "of_text", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("start") + F.col("count") + SPAN - 1).alias("finish"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("of_text", "start", "finish")).alias("spans"))
    )
    changed = texts.join(spans, "doc_id").mapInArrow(_removed, "doc_id long, digest binary, n_removed long, n_spans long, kept binary")
    changed = changed.select("doc_id", "digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"), *(["kept"] if kept else []))
    changed = staged(changed.dropDuplicates(["doc_id", "digest"]), "changed")
    whole = rows.join(heads, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("earliest"), F.lit(False)))
    done = whole.join(changed, ["doc_id", "digest"], "left")
    copy = F.col("copy")
    return done.select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(copy, F.col("n_bytes").cast("long")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if kept else []),
    )
