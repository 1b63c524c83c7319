"""Exact search of vectors: blocks of items against blocks of queries, as products of matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Rows of a block of items and of a block of queries; a product of two blocks is all that is held at once.
ITEMS, ASKED = 1024, 2048
#: Pairs whose exact scores are made at once.
PAIRS = 1 << 17
#: A score of matrices may differ from the exact, rounded one by less than this: half of a sixth digit and what sums of doubles lose.
SLACK = 1e-6
#: Norms outside have squares near the ends of doubles; such vectors skip the products and are compared exactly.
TINY, HUGE = 1e-100, 1e100

Block = tuple[np.ndarray, np.ndarray]


def vectors(column: pa.ChunkedArray | pa.Array) -> dict[int, Block]:
    """By length, the rows and the doubles of a column of lists. Null vectors, and those with a null inside, are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    kept = column.take(pa.array(there))
    flat = kept.flatten()
    sizes = np.asarray(kept.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    holes = np.concatenate([[0], np.cumsum(~flat.is_valid().to_numpy(zero_copy_only=False))])
    whole = holes[starts[1:]] == holes[starts[:-1]]
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[whole]):
        rows = np.flatnonzero(whole & (sizes == n))
        if n:
            out[int(n)] = (there[rows], values[starts[rows][:, None] + np.arange(n)])
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, summed from the first place to the last, as Spark sums."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, half up by the shortest decimal form, as Spark rounds."""
    with np.errstate(all="ignore"):
        scaled = x * 1e6
        out = np.where(np.isfinite(scaled) & (np.abs(scaled) < 2**52), np.rint(scaled) / 1e6, x) + 0.0
        close = np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6)
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def _key(x: object) -> tuple:
    return (x is not None, x.encode() if isinstance(x, str) else x)


def _places(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of ids: null first, strings by their bytes."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    names = ids.to_pylist()
    at = {n: i for i, n in enumerate(sorted(set(names), key=_key))}
    return np.array([at[n] for n in names], dtype=np.int64)


def _leading(groups: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the first k of its group; groups lie together."""
    first = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
    return np.arange(len(groups)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k if len(groups) else first


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(v, v))


def _has_norm(norm: np.ndarray) -> np.ndarray:
    """norm > 0, where Spark takes NaN for the greatest number."""
    return (norm > 0) | np.isnan(norm)


def _unit(v: np.ndarray, norm: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(((norm > TINY) & (norm < HUGE))[:, None], v / norm[:, None], np.nan)


class Asked:
    """Distinct query vectors of one length."""

    def __init__(self, v: np.ndarray):
        norm = _norms(v)
        self.rows = np.flatnonzero(_has_norm(norm))
        self.v, self.norm = v[self.rows], norm[self.rows]
        self.unit = _unit(self.v, self.norm)


class Best:
    """The k best items of every query so far, by rounded score and then id."""

    def __init__(self, asked: Asked, k: int, kind: pa.DataType):
        self.asked, self.k = asked, k
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.least = np.full(len(asked.v), -np.inf)

    def add(self, v: np.ndarray, ids: pa.Array) -> None:
        norm = _norms(v)
        rows = np.flatnonzero(_has_norm(norm))
        v, norm, ids = v[rows], norm[rows], ids.take(pa.array(rows))
        # of equal vectors the k first ids are enough
        alike = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((_places(ids), alike))
        kept = np.sort(order[_leading(alike[order], self.k)])
        v, norm, ids = v[kept], norm[kept], ids.take(pa.array(kept))
        unit = _unit(v, norm)
        for a in range(0, len(v), ITEMS):
            for b in range(0, len(self.asked.v), ASKED):
                self._block(v, norm, unit, ids, slice(a, a + ITEMS), slice(b, b + ASKED))

    def _block(self, v: np.ndarray, norm: np.ndarray, unit: np.ndarray, ids: pa.Array, rows: slice, qs: slice) -> None:
        with np.errstate(all="ignore"):
            s = self.asked.unit[qs] @ unit[rows].T
        least = self.least[qs]
        may = ~(s < (least - SLACK)[:, None])  # NaN may
        if np.count_nonzero(may) > 4 * self.k * len(s) and s.shape[1] > self.k:
            here = np.partition(np.where(np.isnan(s), -np.inf, s), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            may = ~(s < (np.maximum(least, here - SLACK) - SLACK)[:, None])
        q, i = np.nonzero(may)
        q, i = q + qs.start, i + rows.start
        for at in range(0, len(q), PAIRS):
            self._merge(q[at : at + PAIRS], i[at : at + PAIRS], v, norm, ids)

    def _merge(self, q: np.ndarray, i: np.ndarray, v: np.ndarray, norm: np.ndarray, ids: pa.Array) -> None:
        with np.errstate(all="ignore"):
            score = rounded(dots(v[i], self.asked.v[q]) / (norm[i] * self.asked.norm[q]))
        # only the queries at hand are sorted again
        old = np.isin(self.q, np.unique(q))
        rest, ids_rest = np.flatnonzero(~old), self.ids.take(pa.array(np.flatnonzero(~old)))
        q, score = np.concatenate([self.q[old], q]), np.concatenate([self.score[old], score])
        ids = pa.concat_arrays([self.ids.filter(pa.array(old)), ids.take(pa.array(i))])
        odd = np.isnan(score)
        order = np.lexsort((_places(ids), -np.where(odd, 0.0, score), ~odd, q))
        order = order[_leading(q[order], self.k)]
        q, score, ids = q[order], score[order], ids.take(pa.array(order))
        last = np.flatnonzero(np.concatenate([q[1:] != q[:-1], [True]]))
        full = last[np.bincount(q, minlength=len(self.least))[q[last]] >= self.k]
        self.least[q[full]] = np.where(np.isnan(score[full]), np.inf, score[full])
        self.q, self.score, self.ids = np.concatenate([self.q[rest], q]), np.concatenate([self.score[rest], score]), pa.concat_arrays([ids_rest, ids])


def searcher(asked: pa.Array, k: int) -> Callable[[Iterator[pa.RecordBatch], pa.DataType], Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]]:
    """A function of batches (chunk_id, embedding), to the row of the query, score and id of the k best of each distinct query vector among them."""
    known = {}
    for n, (rows, v) in vectors(asked).items():
        a = Asked(v)
        if len(a.v):
            known[n] = (rows[a.rows], a)

    def search(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        best = {n: Best(a, k, kind) for n, (_, a) in known.items()}
        for batch in batches:
            for n, (rows, v) in vectors(batch.column(1)).items():
                if n in best:
                    best[n].add(v, batch.column(0).take(pa.array(rows)))
        for n, b in best.items():
            yield known[n][0][b.q], b.score, b.ids

    return search
