"""Evaluation of answers: which questions are open, metrics from verdicts, and the policy for errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.retrieval import cosine
from foliant.operators.sessions import precision_at_k

METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")
PENDING, DONE, ERROR = "PENDING", "DONE", "ERROR"
#: Words of a spent quota in an error, how often it may come before the key changes, and rests in seconds.
LIMITED = r"429|quota|exhausted|limit"
TRIES, SHORT_REST, PASSING_REST = 3, 65, 10


def first_questions(rows: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The first ``n`` questions in the file's order."""
    return rows.orderBy(order).limit(n)


def resumed(questions: DataFrame, results: DataFrame) -> DataFrame:
    """``questions`` (question, ...) with what an earlier run left of answer, contexts, metrics and status (PENDING where it left none)."""
    kept = ["answer", "contexts", *METRICS, "status"]
    j = questions.join(results.select("question", *kept), "question", "left")
    return j.withColumn("status", F.coalesce("status", F.lit(PENDING)))


def open_questions(rows: DataFrame) -> DataFrame:
    """All that aren't done, errors among them."""
    return rows.where(~F.col("status").eqNullSafe(DONE))


def open_cells(rows: DataFrame) -> DataFrame:
    """question and metric of every cell still to be filled."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return open_questions(rows).select("question", F.explode(cells).alias("c")).where("c.value IS NULL").select("question", "c.metric")


def answered(rows: DataFrame, retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` (question_id, answer, contexts, ...) with answers and contexts where they lack one. ``retrieved``: query_id, rank, text; contexts are an array in rank order."""
    held = F.array_sort(F.collect_list(F.struct("rank", "text")))
    contexts = retrieved.groupBy("query_id").agg(F.transform(held, lambda r: r["text"]).alias("__contexts"))
    j = rows.join(contexts, F.col("question_id") == F.col("query_id"), "left").drop("query_id")
    j = j.join(answers.select("query_id", F.col("answer").alias("__answer")), F.col("question_id") == F.col("query_id"), "left").drop("query_id")
    lacks = F.coalesce("answer", F.lit("")) == ""
    j = j.withColumn("contexts", F.when(lacks, F.col("__contexts")).otherwise(F.col("contexts"))).withColumn("answer",
        F.when(lacks, F.col("__answer")).otherwise(F.col("answer")))
    return j.drop("__contexts", "__answer")


def share(verdict: Column) -> Column:
    """The share of claims that hold, to 6 digits; null without claims."""
    return F.round(F.avg(verdict.cast("double")), 6)


def metrics(contexts: DataFrame, claims: DataFrame, truths: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id and the four METRICS from a judge's verdicts, each null where it gave none.

    ``contexts``: question_id, rank, verdict of each context; ``claims``: question_id, supported of each claim of an
    answer; ``truths``: question_id, supported of each claim of the true answer; ``questions``: question_id, vector,
    made: the question's vector and one of a question made from the answer.
    """
    precision = precision_at_k(contexts).select("question_id", "context_precision")
    recall = truths.groupBy("question_id").agg(share(F.col("supported")).alias("context_recall"))
    faithful = claims.groupBy("question_id").agg(share(F.col("supported")).alias("faithfulness"))
    relevant = questions.groupBy("question_id").agg(F.round(F.avg(cosine(F.col("vector"), F.col("made"))), 6).alias("answer_relevancy"))
    out = precision.join(recall, "question_id", "full_outer").join(faithful, "question_id", "full_outer").join(relevant, "question_id", "full_outer")
    return out.select("question_id", *METRICS)


def finished(rows: DataFrame) -> DataFrame:
    """``rows`` with status DONE where every metric is there."""
    full = F.lit(True)
    for m in METRICS:
        full = full & F.col(m).isNotNull()
    return rows.withColumn("status", F.when(full, F.lit(DONE)).otherwise(F.col("status")))


def next_step(message: Column, error_type: Column, in_a_row: Column) -> Column:
    """After an error: (action, rest): another key after TRIES limits in a row, else the same after a rest; a timeout rests; anything else gives the question up."""
    step = lambda action, rest: F.struct(F.lit(action).alias("action"), F.lit(rest).alias("rest"))
    limited = F.lower(message).rlike(LIMITED)
    passing = F.coalesce(error_type.contains("Timeout"), F.lit(False)) | message.contains("Timeout")
    return F.when(limited & (in_a_row >= TRIES), step("next_key", 0)).when(limited, step("again", SHORT_REST)).when(passing,
        step("again", PASSING_REST)).otherwise(step("give_up", PASSING_REST))
