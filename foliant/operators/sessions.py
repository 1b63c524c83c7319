"""Chat sessions, cooldowns, users and evaluation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def accepted_requests(requests: DataFrame, seconds: float) -> DataFrame:
    """(user_id, event_id, ts, accepted): a request is accepted if the user's last accepted one lies ``seconds`` back at least.

    Requests of one time go by event_id; without a user or a time they're refused. Each user's requests are read in
    order, and nothing of them is held but the last accepted time, so a user's history may be of any length.
    """
    least = int(seconds * 1_000_000)
    ordered = requests.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ordered = ordered.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    schema = T.StructType([*[ordered.schema[c] for c in ("user_id", "event_id", "ts")], T.StructField("accepted", T.BooleanType())])

    def walk(batches):
        user, last = None, None
        for b in batches:
            accepted = []
            for u, t in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if u != user:
                    user, last = u, None
                ok = u is not None and t is not None and (last is None or t - last >= least)
                last = t if ok else last
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(accepted, pa.bool_())], names=schema.names)

    return ordered.mapInArrow(walk, schema)


def wait_message(seconds: float, since: Column) -> Column:
    """What a refused request is told: whole seconds that are left."""
    left = F.floor(F.lit(float(seconds)) - since).cast("string")
    return F.concat(F.lit("Vui lòng đợi "), left, F.lit(" giây trước khi gửi câu hỏi tiếp theo."))


def new_sessions(requests: DataFrame) -> DataFrame:
    """session_id, user_id, title, created_at, messages (none yet) for the requests (request_id, user_id, query, at) that name no session."""
    fresh = requests.where(F.coalesce("session_id", F.lit("")) == "")
    return fresh.select("request_id", F.expr("uuid()").alias("session_id"), "user_id", title(F.col("query")).alias("title"),
        F.col("at").alias("created_at"), F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)").alias("messages"))


def history(sessions: DataFrame, user: str) -> DataFrame:
    """A user's sessions without their messages, the newest first."""
    return sessions.where(F.col("user_id") == user).drop("messages").orderBy(F.col("created_at").desc(), "session_id")


def session(sessions: DataFrame, session_id: str, user: str) -> DataFrame:
    """The session, if it is the user's; no row is what 404 was."""
    return sessions.where((F.col("session_id") == session_id) & (F.col("user_id") == user))


def without_session(sessions: DataFrame, session_id: str, user: str) -> tuple[DataFrame, DataFrame]:
    """The sessions but that one, and how many were deleted (deleted)."""
    hit = F.coalesce((F.col("session_id") == session_id) & (F.col("user_id") == user), F.lit(False))
    return sessions.where(~hit), sessions.agg(F.count_if(hit).alias("deleted"))


def title(query: Column, length: int = 50) -> Column:
    """The query, cut to ``length`` and marked with three dots."""
    return F.when(F.length(query) > length, F.concat(F.left(query, F.lit(length)), F.lit("..."))).otherwise(query)


def push(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with new messages (session_id, turn, role, text) appended; see lost_messages()."""
    new = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("more"))
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    return sessions.join(new, "session_id", "left").withColumn("messages", F.concat("messages", F.coalesce("more", none))).drop("more")


def lost_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of no session, which push() has nowhere to put."""
    return messages.join(sessions.select("session_id"), "session_id", "left_anti")


def set_role(users: DataFrame, emails: list[str], role: str, protected: str) -> DataFrame:
    """Roles overwritten, but for the protected account."""
    hit = F.lower("email").isin([e.lower() for e in emails]) & (F.lower("email") != protected.lower())
    return users.withColumn("role", F.when(hit, F.lit(role)).otherwise(F.col("role")))


def precision_at_k(verdicts: DataFrame) -> DataFrame:
    """(question_id, context_precision, context_recall) from verdicts 0/1 by rank."""
    so_far = F.sum("verdict").over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    at = verdicts.withColumn("p", so_far / F.col("rank"))
    return at.groupBy("question_id").agg(F.round(F.sum(F.col("p") * F.col("verdict")) / F.nullif(F.sum("verdict"), F.lit(0)),
        6).alias("context_precision"), F.round(F.avg("verdict"), 6).alias("context_recall"))
