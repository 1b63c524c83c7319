"""Encoding and decoding with the pieces of a SentencePiece model.

An Aho-Corasick automaton over the pieces runs once over a word and gives, by its output links, all pieces that end at
each character; each relaxes the best score of the place where it ends. In a unigram model that is all. The result of a
model of BPE type isn't the segmentation of greatest summed score but the one that merges leave: there a piece relaxes a
place only if it and the last piece before it are what merging makes of their two strings together. A sequence in which
that holds for all neighbours is the merged one.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.common import Recent, map_texts, only_held

SPACE = "▁"
UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: A model file's types, and by how much an unknown character scores less than the worst piece.
UNIGRAM, BPE, UNKNOWN_LOSS = 1, 2, 10.0
LOST = float("-inf")
#: So many pairs of pieces are remembered at most.
PAIRS = 500_000
#: Strings up to this length are merged by plain search.
SHORT = 48


def fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a message in protocol buffers' wire format: whole numbers, or bytes."""

    def number(at):
        out = shift = 0
        while True:
            out |= (message[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 0x80:
                return out, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The pieces of a model: automaton, merging and byte fallback.

    Models of unigram and BPE type whose texts aren't normalised and keep all white space; others raise ValueError.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = f.read()
        parts = dict(fields(proto))  # of the pieces, many of one number, the last alone
        trainer, normalizer = dict(fields(parts.get(2, b""))), dict(fields(parts.get(3, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"neither a unigram nor a BPE model: {path}")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError(f"the model normalises its texts: {path}")
        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        self.piece = [m.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = m.unk_id()
        self.silent = {i for i in range(n) if m.is_control(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_LOSS
        #: Whether a space stands at the start of pieces alone, so that words are encoded by themselves.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p), self.score[p]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.unit = Recent(self._unit_bytes)

    def merged(self, s: str) -> list[str]:
        """Merging by its definition: the neighbours whose joint piece scores best, the leftmost of equals, until none are left."""
        return self.merged_short(list(s)) if len(s) <= SHORT else self.merged_long(s)

    def merged_short(self, parts: list[str]) -> list[str]:
        score = self.score.get
        while True:
            scores = [score(a + b, LOST) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores, default=LOST)
            if best == LOST:
                return parts
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def merged_long(self, s: str) -> list[str]:
        """Each merge makes two new neighbours, so a heap does it in n log n."""
        parts: list[str] = list(s)
        right, left = [*range(1, len(s)), -1], list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i):
            if i >= 0 and right[i] >= 0:
                joint = parts[i] + parts[right[i]]
                if joint in self.score:
                    heapq.heappush(heap, (-self.score[joint], i, joint))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, joint = heapq.heappop(heap)
            if not parts[i] or right[i] < 0 or parts[i] + parts[right[i]] != joint:
                continue  # one of the two has merged otherwise
            gone = right[i]
            parts[i], parts[gone], right[i] = joint, "", right[gone]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [p for p in parts if p]

    def apart_when_merged(self, last: int, i: int) -> bool:
        """Whether merging leaves pieces ``last`` and ``i`` apart. Remembered in pairs."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.piece[last], self.piece[i]
        out = self.pairs[last * len(self.piece) + i] = self.merged(a + b) == [a, b]
        return out

    def segment(self, s: str) -> list[int]:
        """Ids of a unit: the best path of pieces over it. In a BPE model one piece at most passes at a place, so that its first stays."""
        n, free, known, pairs, pieces = len(s), self.kind == UNIGRAM, self.id, self.pairs, len(self.piece)
        best = [LOST] * (n + 1)
        last, length = [-2] * (n + 1), [0] * (n + 1)  # of each end: last piece's id (-1: a character without piece) and length
        best[0], done = 0.0, 0
        gaps = not known.keys() >= set(s)

        def unknown(up_to):
            """Characters without a piece of their own count as unknown."""
            for at in range(done, up_to):
                score = best[at] + self.unknown_score
                if s[at] not in known and score > best[at + 1]:
                    best[at + 1], last[at + 1], length[at + 1] = score, -1, 1

        for end, (i, size, own) in self.automaton.iter(s):
            if gaps and done < end:
                unknown(end)
                done = end
            at, end = end + 1 - size, end + 1
            score = best[at] + own
            if score > best[end] and (free or best[end] == LOST):
                before = last[at]
                passes = free or before < 0
                if not passes:
                    passes = pairs.get(before * pieces + i)
                    if passes is None:
                        passes = self.apart_when_merged(before, i)
                if passes:
                    best[end], last[end], length[end] = score, i, size
        if gaps:
            unknown(n)
        if best[n] == LOST:  # equal scores can leave a BPE unit without a path of pairs
            return self.ids_of(self.merged(s))
        out: list[int] = []
        end = n
        while end:
            if last[end] >= 0:
                out.append(last[end])
            elif self.byte or not out or out[-1] != self.unknown or not free:
                out.extend(self.fallback(s[end - 1])[::-1])
            end -= length[end]
        return out[::-1]

    def ids_of(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.id[p]] if p in self.id else self.fallback(p))]

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]

    def unit_ids(self, s: str) -> list[int]:
        if self.kind == BPE and s.startswith(SPACE * 2):
            # pieces of spaces alone share one score, so that pairs don't tell; such runs are merged by definition
            return self.ids_of(self.merged(s))
        return self.segment(s)

    def _unit_bytes(self, s: str) -> bytes:
        return np.asarray(self.unit_ids(s), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text. Where pieces have the mark of a space at their start alone, what stands between spaces is encoded by itself."""
        if not text:
            return b""
        s = SPACE + text.replace(" ", SPACE)
        return b"".join(map(self.unit.__getitem__, UNITS.findall(s))) if self.apart else self._unit_bytes(s)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        out, held = [], bytearray()
        for i in numbers:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.silent:
                out.append(self.piece[i] if i != self.unknown else " ⁇ ")
        if held:
            out.append(held.decode("utf-8", "replace"))
        s = "".join(out)
        return (s[1:] if s.startswith(SPACE) else s).replace(SPACE, " ")


def pieces(path: str) -> Pieces:
    return only_held(("pieces", path), lambda: Pieces(path))


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep``, n_pieces, n_byte_pieces, ids_crc32 and lossless (the decoded text is the text) of every whole text; with ``with_ids`` also ids.

    Null text counts as empty: no pieces, lossless. Repeated rows stay as many rows; an empty table gives none; other
    columns aren't read. No shuffle; a worker holds the model and bounded caches.
    """
    kinds = {"n_pieces": T.LongType(), "n_byte_pieces": T.LongType(), "ids_crc32": T.LongType(), "lossless": T.BooleanType()}
    if with_ids:
        kinds["ids"] = T.ArrayType(T.IntegerType())

    def start():
        p = pieces(path)
        low, high = min(p.byte_of, default=0), max(p.byte_of, default=-1)

        def f(texts):
            out = [[] for _ in kinds]
            for t in texts:
                ids = p.encode(t)
                n = np.frombuffer(ids, "<u4")
                row = [len(n), int(((n >= low) & (n <= high)).sum()), zlib.crc32(ids), p.decode(ids) == (t or "")]
                for column, v in zip(out, [*row, n.tolist()], strict=False):
                    column.append(v)
            return out

        return f

    return map_texts(docs, list(keep), start, [T.StructField(k, v) for k, v in kinds.items()], text)


def decode_documents(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and text of every array of ids; null ids give null."""
    src = rows.select(*keep, ids)

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        for b in batches:
            texts = [None if v is None else p.decode(np.asarray(v, "<u4").tobytes()) for v in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in keep], T.StructField("text", T.StringType())]))
