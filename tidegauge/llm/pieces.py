"""Encoding texts into sentence pieces, and back, with forward states shared along common prefixes.

A text is spaces marked as a letter, cut into marked words that no piece crosses. The distinct words of
a batch are sorted; in that order they are the leaves of a trie visited depth first, and what was
computed for the prefix two neighbours share is kept. For a unigram model the state of a prefix is its
best score and the piece it ends with (Viterbi). A model of merges has no such score: its state is the
one piece the merges leave at the end of the prefix, which is the longest that is not merged any
further with the piece before it. Both read the result back from the last state.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from tidegauge.llm.common import per_batch

MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words a worker remembers (one batch may add to them), and the longest of them.
REMEMBERED, LONGEST_WORD = 150_000, 64
#: How much worse than the worst piece an unknown character scores (of unigram models).
UNKNOWN_PENALTY = 10.0


def piece_model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Pieces, scores and rules of a model. Only models without a normalisation table, user-defined and
    unused pieces are taken; others raise ValueError, since their ids would differ."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, squeeze: bool = False):
        if kind not in (UNIGRAM, MERGES) or any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("only unigram and merge models of plain pieces are supported")
        self.kind, self.dummy_prefix, self.squeeze = kind, dummy_prefix, squeeze
        self.pieces = [p for p, _, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.scores = {p: s for p, s, t in pieces if t == NORMAL}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        joined = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            self.words = re.compile(r".+", re.S)  # pieces span words: a text is one word
        elif any(c.isspace() for p in joined for c in p):
            self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.words = re.compile(rf"{MARK}*[^{MARK}\s]+|{MARK}+|\s")
        # Lengths of the pieces that can end in four characters, the longest first; filled as ends are met.
        self.lengths: dict[str, list[int]] = {}
        self.long_lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 4:
                self.long_lengths.setdefault(p[-4:], set()).add(len(p))
        self.ends_with = lru_cache(1 << 17)(self._ends_with)
        self.edges = lru_cache(None)(self._edges)
        self.known: dict[str, bytes] = {}
        self.coded = {p: array("i", [i]).tobytes() for p, i in self.ids.items()}
        self.plain = [self._shown(i) for i in range(len(pieces))]
        self.high = np.array([t == BYTE and int(p[3:5], 16) > 127 for p, _, t in pieces])

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or proto.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("only models without a normalisation table are supported")
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        return cls(pieces, proto.trainer_spec.model_type, rules.add_dummy_prefix, rules.remove_extra_whitespaces)

    def marked(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What the merges make of a short string, done step by step: the adjacent pair that is the best
        scored piece, the leftmost of these, is joined until none is a piece. With the last pair joined."""
        parts, last = list(text), None
        while True:
            pairs = [(self.scores.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]  # noqa: B905
            best = max((p for p in pairs if p[0] is not None), default=None)
            if best is None:
                return parts, last
            i = -best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _edges(self, piece: str) -> tuple[list[str], list[str]] | None:
        """The strings that are first, and last, in the piece while it is merged, from a character to
        itself. None if merges don't make the piece, or not from parts with better scores than its own."""
        parts, last = self.merged(piece)
        if parts != [piece]:
            return None
        if last is None:
            return [piece], [piece]
        one, two = map(self.edges, last)
        if one is None or two is None or any(len(x) > 1 and self.scores[x] <= self.scores[piece] for x in last):
            return None
        return [*one[0], piece], [*two[1], piece]

    def _ends_with(self, before: str, piece: str) -> bool:
        """Whether the merges of before + piece leave these two. Where every part has a better score than
        what it becomes, merges happen in the order of scores, so it is enough to look at the strings
        that meet at the border, in that order."""
        if not before:
            return self.merged(piece)[0] == [piece]
        one, two = self.edges(before), self.edges(piece)
        if one is None or two is None:
            return self.merged(before + piece)[0] == [before, piece]
        left, right, i, j, get = one[1], two[0], 0, 0, self.scores.get
        never = -np.inf
        while True:
            next_left = get(left[i + 1]) if i + 1 < len(left) else never
            next_right = get(right[j + 1]) if j + 1 < len(right) else never
            across = get(left[i] + right[j], never)
            if across > next_left and across >= next_right and across > never:
                return False
            if next_left == next_right == never:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _ends(self, end: str) -> list[int]:
        """Lengths from two of the pieces that a prefix with this end, its last four characters, can end in."""
        if len(self.lengths) > REMEMBERED:
            self.lengths.clear()
        short = [n for n in (4, 3, 2) if n <= len(end) and end[-n:] in self.ids]
        self.lengths[end] = found = [*sorted(self.long_lengths.get(end, ()), reverse=True), *short]
        return found

    def _extend(self, word: str, i: int, lengths: list[int], scores: list[float]) -> None:
        """The state of the prefix of i characters, from those of the shorter ones."""
        if self.kind == MERGES:
            ids, ends_with = self.ids, self.ends_with
            for n in self._ends(word[max(i - 4, 0) : i]):
                if n <= i and (piece := word[i - n : i]) in ids:
                    if ends_with(word[i - n - lengths[i - n] : i - n], piece):
                        lengths.append(n)
                        return
            lengths.append(1)
            return
        best, chosen = -np.inf, 1
        for n in range(1, min(self.longest, i) + 1):
            score = self.scores.get(word[i - n : i], self.worst if n == 1 else None)
            if score is not None and scores[i - n] + score > best:
                best, chosen = scores[i - n] + score, n
        lengths.append(chosen)
        scores.append(best)

    def _ids_of(self, word: str, lengths: list[int]) -> bytes:
        found, i = [], len(word)
        while i:
            piece = word[i - lengths[i] : i]
            own = self.ids.get(piece)
            if own is not None:
                found.append(own)
            elif self.bytes:
                found.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "replace")))
            else:
                found.append(self.unknown)
            i -= lengths[i]
        found.reverse()
        return array("i", found).tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Encode words in sorted order; each starts from the states of the prefix it shares with the
        one before."""
        last, lengths, scores = "", [0], [0.0]
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del lengths[shared + 1 :], scores[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                self._extend(word, i, lengths, scores)
            self.known[word] = self._ids_of(word, lengths)
            last = word

    def learn_short(self, words: Iterable[str]) -> None:
        """learn() for a model of merges and short words: the ids of every prefix are kept with its state,
        so that a word's are there when its last character is."""
        lengths_of, ends_with, known, coded = self.lengths.get, self.ends_with, self.known, self.coded
        last, lengths, found = "", [0], [b""]
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del lengths[shared + 1 :], found[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                end = word[i - 4 if i > 4 else 0 : i]
                ends = lengths_of(end)
                for n in self._ends(end) if ends is None else ends:
                    if n <= i and (code := coded.get(piece := word[i - n : i])) is not None:
                        if ends_with(word[i - n - lengths[i - n] : i - n], piece):
                            break
                else:
                    n, code = 1, coded.get(word[i - 1]) or self._coded(word[i - 1])
                lengths.append(n)
                found.append(found[i - n] + code)
            known[word] = found[-1]
            last = word

    def _coded(self, piece: str) -> bytes:
        self.coded[piece] = found = self._ids_of(piece, [0, *range(1, len(piece) + 1)])
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; none for a null or empty text."""
        split = [self.words.findall(self.marked(t or "")) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = {w for words in split for w in words if w not in self.known}
        short = {w for w in fresh if len(w) <= LONGEST_WORD} if self.kind == MERGES else set()
        self.learn_short(short)
        self.learn(fresh - short)
        known = self.known
        found = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.intc) for words in split]
        for w in fresh:
            if len(w) > LONGEST_WORD:
                del known[w]
        return found

    def _shown(self, i: int) -> str:
        kind = self.types[i]
        if kind == BYTE:
            return chr(int(self.pieces[i][3:5], 16))
        return " ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i].replace(MARK, " ")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces are joined to characters (what is no UTF-8 shows as U+FFFD),
        control pieces are nothing, and the space that encoding put first goes."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if self.high[ids].any():
            parts, run = [], bytearray()
            for i in ids.tolist():
                if self.types[i] == BYTE:
                    run.append(int(self.pieces[i][3:5], 16))
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(self.plain[i])
            parts.append(run.decode("utf-8", "replace"))
        else:
            parts = map(self.plain.__getitem__, ids.tolist())
        text = "".join(parts)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(2)
def _model(path: str) -> PieceModel:
    """Once a worker, with the words it has met."""
    return PieceModel.load(path)


def encoded(text: str | Column, path: str | None = None) -> Column:
    """Piece ids of whole texts as array<int>; empty for null and empty texts."""
    path = path or piece_model_path()

    def batch_of(batch: pa.Array) -> pa.Array:
        return pa.array(_model(path).encode(batch.to_pylist()), pa.list_(pa.int32()))

    return per_batch(lambda: batch_of, "array<int>")(text)


def decoded(ids: str | Column, path: str | None = None) -> Column:
    """The texts of arrays of piece ids; null stays null. An id outside the model fails."""
    path = path or piece_model_path()

    def batch_of(batch: pa.Array) -> pa.Array:
        model = _model(path)
        values, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
        rows = zip(ends[:-1].tolist(), ends[1:].tolist(), batch.is_valid().to_pylist(), strict=True)
        return pa.array([model.decode(values[a:b]) if there else None for a, b, there in rows], pa.string())

    return per_batch(lambda: batch_of, "string")(ids)
