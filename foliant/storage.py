"""Intermediate tables in the folder that all executors share, and joins whose broadcast side is measured."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this is a hot one, and so many rows at most are broadcast.
HOT, BROADCAST_ROWS = 4096, 1_000_000
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors share.

    On a cluster the session must name that place in spark.checkpoint.dir. A session of one process may leave it unset,
    and gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    _made.append(f"{base.rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and its lineage cut so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Removes what stored() wrote for ``tables``; whatever still needs them must have been stored since."""
    for t in tables:
        _remove(t.sparkSession, t._foliant_path)
        _made.remove(t._foliant_path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what the operators stored inside. Their results must have been written or collected by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _remove(spark, path)
        del _made[before:]


def hinted(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has BROADCAST_ROWS rows at most; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def joined(big: DataFrame, small: DataFrame, on: list[str], heat: str) -> DataFrame:
    """Inner join by ``on`` with ``small``, whose column ``heat`` says how many rows of ``big`` its key has.

    Rows of hot keys never meet in one task: these keys, at most 1 / HOT of all rows and BROADCAST_ROWS in number, are
    broadcast and leave the shuffle; the others are joined as Spark likes.
    """
    limits = [HOT * 8**j for j in range(7)]
    hot_keys = list(small.agg(*[F.count_if(F.col(heat) > t) for t in limits]).head())
    limit = next((t for t, n in zip(limits, hot_keys, strict=True) if n <= BROADCAST_ROWS), limits[-1])
    if not hot_keys[limits.index(limit)]:
        return big.join(small.drop(heat), on)
    hot = small.where(F.col(heat) > limit)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(heat) <= limit).drop(heat), on)
    return rest.unionByName(big.join(F.broadcast(hot.drop(heat)), on))
