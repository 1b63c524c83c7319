"""Best-fit packing of token pieces by patterns of few lengths.

The histogram of piece lengths has at most ``max_len`` bins whatever the corpus. Patterns of up to three lengths that
fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares (block
pricing of new patterns, coordinate descent on the active ones), the counts rounded down to what the histogram holds, and
what is left packed best-fit decreasing, whole bins at a time. The plan is a table of segments - the documents of one
length with ranks in a range go to consecutive sequences at one offset - and its size depends on ``max_len`` alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from foliant.llm.common import Recent, map_texts, only_held, stored

#: Texts with other code points go to the library whole; for these, tests compare normalisation and splitting for every code point.
OTHER = regex.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-įı-ž]")
ROUNDS, ADDED, SWEEPS = 10, 400, 12


def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Fixed value: the pre-token pattern of the word tokenizer.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHE_PARTS, CACHE_WORDS = 150_000, 60_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it's printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


def part_encoder(t: Tokenizer) -> Recent:
    """The ids of parts without white space, as bytes: pre-tokens by the pattern, each distinct one merged by the library's model alone."""
    model, letters = t.model, byte_letters()

    def merged(word: str) -> bytes:
        seen = word if word.isascii() and word.isprintable() else "".join(map(letters.__getitem__, word.encode()))
        return np.asarray([x.id for x in model.tokenize(seen)], "<u4").tobytes()

    words = Recent(merged, CACHE_WORDS)  # of parts that aren't one word
    return Recent(lambda part: merged(part) if part.isalpha() else b"".join(map(words.__getitem__, PRE_TOKEN.findall(part))), CACHE_PARTS)


def encode_ids(path: str, text: str | None) -> bytes:
    """The little-endian 32-bit ids of a whole text as the library gives them, without special tokens of its own.

    No pre-token has white space in it or looks beyond itself, so the ids of a text are those of its space-separated
    parts in a row; each distinct part is encoded once while it's in the cache.
    """
    if not text:
        return b""
    t, parts = only_held(("parts", path), lambda: (t := tokenizer(path), part_encoder(t)))
    if "<|" in text or OTHER.search(text):
        return np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(parts.__getitem__, text.lower().split()))


def token_pieces(docs: DataFrame, path: str, max_len: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut where longer than ``max_len``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def start():
        def f(texts):
            rows, piece, first, length, crc = [], [], [], [], []
            for row, t in enumerate(texts):
                ids = memoryview(encode_ids(path, t) + end)
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    rows.append(row), piece.append(k), first.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            return [rows, piece, first, length, crc]

        return f

    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()}
    return map_texts(docs, [doc_id], start, [T.StructField(k, v) for k, v in kinds.items()], text, repeats=True)


def patterns(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """All multisets of one to three of ``lengths`` that sum to ``max_len``, as rows padded with 0."""
    have = np.zeros(max_len + 1, bool)
    have[lengths] = True
    have[0] = True  # no document
    found = []
    for a in np.flatnonzero(have)[::-1]:
        rest = max_len - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        c = rest - b
        ok = have[b] & have[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(hist: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of pattern counts against the histogram: the active patterns and their real counts."""
    h = hist.astype(float)
    h[0] = 0
    left, active, x = h.copy(), [], {}
    for _ in range(ROUNDS):
        if not len(rows):
            break
        gain = left[rows].sum(1)
        order, used, added = np.argsort(-gain)[: 40 * ADDED], np.zeros(len(h), bool), 0
        for p in order:
            a, b, c = rows[p]
            if gain[p] <= 1 or added >= ADDED:
                break
            if not (used[a] or used[b] and b or used[c] and c):
                used[[a, b, c]] = True
                added += 1
                if p not in x:
                    active.append(p)
                    x[p] = 0.0
        if not added:
            break
        parts = [(p, [int(v) for v in rows[p] if v]) for p in active]
        weight = {p: sum(part.count(v) for v in part) for p, part in parts}
        r = left.tolist()
        for _ in range(SWEEPS):
            for p, part in parts:
                step = max(-x[p], sum(r[v] for v in part) / weight[p])
                if step:
                    x[p] += step
                    for v in part:
                        r[v] -= step
        left = np.asarray(r)
        active = [p for p in active if x[p] > 0]
        x = {p: x[p] for p in active}
    return rows[active], np.asarray([x[p] for p in active])


def plan_segments(hist: np.ndarray, max_len: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first, offset) that place every document of the histogram."""
    left, taken, sequences = hist.astype(np.int64).copy(), np.zeros(max_len + 1, np.int64), 0

    def place(v, n, seq, offset):
        lo = int(taken[v])
        taken[v] += n
        left[v] -= n
        return v, lo, lo + n, seq, offset

    fitted, counts = fit_counts(hist, patterns(np.flatnonzero(hist), max_len))
    for k in np.argsort(-counts, kind="stable"):
        part = [int(v) for v in fitted[k] if v]
        n = min(int(counts[k]), *(int(left[v]) // part.count(v) for v in part))
        if n <= 0:
            continue
        offset = 0
        for v in part:
            yield place(v, n, sequences, offset)
            offset += v
        sequences += n
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences
    for v in range(max_len, 0, -1):
        while left[v]:
            rooms = sorted(r for r, runs in free.items() if runs and r >= v)
            if rooms:
                room = rooms[0]
                seq, n = free[room].pop()
            else:
                fits = max_len // v
                room, seq = max_len, sequences
                n = -(-int(left[v]) // fits)
                sequences += n
            m = min(n, int(left[v]))
            yield place(v, m, seq, max_len - room)
            if room > v:
                free.setdefault(room - v, []).append((seq, m))
            if n > m:
                free.setdefault(room, []).append((seq + m, n - m))


def pack_pieces(pieces: DataFrame, max_len: int) -> DataFrame:
    """The rows of ``pieces`` (column length, 1 to ``max_len``) with sequence_id and offset. ``pieces`` must be stored: it's read three times.

    The rank of a piece among those of its length is counted in two levels, hashed shares of a length first, so that a
    length which holds most rows is no single task's.
    """
    spark = pieces.sparkSession
    hist = np.zeros(max_len + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most max_len rows
        hist[row[0]] = row[1]
    segments = spark.createDataFrame([tuple(map(int, s)) for s in plan_segments(hist, max_len)] or [], "length long, lo long, hi long, seq long, offset long")
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    shared = pieces.withColumn("__share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    sizes = shared.groupBy("length", "__share").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "__share", before.alias("__before"))
    inside = Window.partitionBy("length", "__share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = shared.withColumn("__own", F.row_number().over(inside)).join(sizes, ["length", "__share"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__own") - 1).drop("__share", "__own", "__before")
    seg = F.broadcast(segments.withColumnRenamed("length", "__length"))
    hit = (ranked["length"] == seg["__length"]) & (ranked["__rank"] >= seg["lo"]) & (ranked["__rank"] < seg["hi"])
    return ranked.join(seg, hit).select(*pieces.columns, (F.col("seq") + F.col("__rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document (null text: empty) as token pieces packed into few sequences of at most ``max_len`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows and null ids are packed like any
    others; an empty table gives no rows; other columns aren't read.
    """
    return pack_pieces(stored(token_pieces(docs, path, max_len, end_id), "pieces"), max_len)
