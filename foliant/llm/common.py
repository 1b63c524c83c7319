"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliant.functions.text import let  # noqa: F401
from foliant.storage import hinted, joined, release, scratch_path, scratch_scope, stored  # noqa: F401

#: The white space of the contracts (space and U+0009 to U+000D) as a regular expression class body.
BLANK = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that are Python objects at one time in a worker.
ROWS_AT_ONCE = 256


def place_among(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are less than ``value``; looked up in two levels. Null counts as none."""
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    longs = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<bigint>")
    below = lambda bounds: F.coalesce(F.size(F.filter(bounds, lambda c: c < value)), F.lit(0))
    inside = F.coalesce(F.get(F.array(*[longs(g) for g in groups]), below(longs([g[-1] for g in groups]))), longs([]))
    return below(longs([g[-1] for g in groups])) * side + below(inside)


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null taken as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased and nothing else. All-ASCII strings take the fast byte path of lower()."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def words_of(s: Column, separators: str = f"[{BLANK}]+") -> Column:
    """Array of the parts of ``s`` between matches of ``separators``; none for a string without a word. Neither null nor an empty word occurs."""
    return F.filter(F.split(s, separators), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all windows of ``k`` words, in order; with fewer words the whole sequence as one; none without words. ``words`` must be a lambda variable or a plain column."""
    n = F.size(words)
    window = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return (
        F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), window))
        .when(n > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def map_texts(
    df: DataFrame,
    keep: list[str],
    start: Callable[[], Callable[[list], list[list]]],
    fields: list[T.StructField],
    text: str = "text",
    repeats: bool = False,
) -> DataFrame:
    """Columns ``keep`` of every row, then ``fields`` computed from its whole text by Arrow batches.

    ``start`` runs once in each task and gives a function from a list of texts (None for null) to one list for each
    field. With ``repeats`` that function gives first a list of row numbers, so that a text yields any number of rows.
    """
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    src = df.select(*[q(c) for c in keep], q(text).cast("string").alias("__foliant_text"))
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *[f.name for f in fields]]

    def run(batches):
        f = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                kept = [b.column(i) for i in range(len(keep))]
                out = f(b.column(len(keep)).to_pylist())
                if repeats:
                    rows, out = pa.array(out[0], pa.int64()), out[1:]
                    kept = [c.take(rows) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=names)

    return src.mapInArrow(run, schema)


class Recent(dict):
    """A cache of bounded size that computes what it lacks. When it's full it becomes the old generation, from which entries that are asked for again come back."""

    def __init__(self, compute: Callable[[str], object], entries: int = 350_000, chars: int = 64):
        super().__init__()
        self.compute, self.entries, self.chars, self.old = compute, entries, chars, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.chars:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_held: dict = {}


def only_held(key: object, make: Callable[[], object]) -> object:
    """What this worker holds for ``key``, made where it's missing. What it held for another key goes first: Spark uses its workers again, and the caches of a job's stages must not add up in them."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
