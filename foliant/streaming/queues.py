"""Work queues and per-user cooldown as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cooldown(requests: DataFrame, seconds: float, delay: str | None = None) -> DataFrame:
    """(user_id, event_id, accepted) of a stream of requests (user_id, event_id, ts); state: each user's last accepted time.

    With ``delay``, how late requests may come, a user's state goes once the watermark has passed the end of the cooldown,
    from when on it would accept a request anyway. Without it states stay. Requests of one batch are read by time, then
    event_id; of a user in one time and batch, state is one number.
    """
    rows = requests.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows if delay is None else rows.withWatermark("ts", delay)

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            ok = last is None or t - last >= seconds * 1_000_000
            last = int(t) if ok else last
            accepted.append(ok)
        if last is not None:
            state.update((last,))
            if delay is not None:
                state.setTimeoutTimestamp(max(int(last / 1000 + seconds * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "accepted": accepted})

    timeout = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(one, "user_id long, event_id long, accepted boolean", "last long", "append", timeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, once, to parquet; a second call continues behind the first."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def work(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, progress: str | None = None) -> StreamingQuery:
    """A query that gives each batch of what is there now to ``step``, and writes (batch, rows, updated_at) to ``progress`` behind it. A batch that fails comes again."""

    def one(batch: DataFrame, number: int) -> None:
        step(batch, number)
        if progress is not None:
            row = batch.agg(F.lit(number).alias("batch"), F.count(F.lit(1)).alias("rows"), F.current_timestamp().alias("updated_at"))
            # a batch that comes again writes the same place again
            row.write.mode("overwrite").parquet(f"{progress}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_stopped(query: StreamingQuery, stopped: Callable[[], bool], every: float = 1.0) -> bool:
    """Waits for ``query``, asking each ``every`` seconds whether to stop it; true if it ran to its end."""
    while query.isActive:
        if stopped():
            query.stop()
            return False
        query.awaitTermination(every)
    return True
