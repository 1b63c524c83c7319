"""Work queues by status columns, and what results do to the rows that were queued.

Queues are filters of a stored table, so that a run that was cut off goes on where it stopped. A missing flag is not a
false one: it passes where only true ones are barred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DONE, SKIPPED, ERROR = "done", "json_error_skipped", "error"


def _order() -> Column:
    return F.col("global_chunk_index").asc_nulls_first()


def enrichment_queue(chunks: DataFrame) -> DataFrame:
    """Active chunks that no model has refined, in the book's order."""
    return chunks.where(~F.col("api_refined") & F.col("active")).orderBy(_order(), "chunk_id")


def graph_queue(chunks: DataFrame) -> DataFrame:
    """Refined active chunks that aren't known to be in the graph."""
    return chunks.where(F.col("api_refined") & F.col("active") & ~F.coalesce("neo4j_synced", F.lit(False))).orderBy(_order(), "chunk_id")


def embedding_queue(chunks: DataFrame, embedded: DataFrame, text: str = "markdown_content") -> DataFrame:
    """Chunks with text and without a vector in ``embedded`` (chunk_id, embedding)."""
    return chunks.where(F.col(text) != "").join(embedded.where("embedding IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti")


def _with_results(chunks: DataFrame, results: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """``chunks`` with the columns ``sets`` of those that have a result (columns r_...); the others stay as they are."""
    r = results.select(*[F.col(c).alias(f"r_{c}") for c in results.columns])
    j = chunks.join(r, F.col("chunk_id") == F.col("r_chunk_id"), "left")
    hit = F.col("r_chunk_id").isNotNull()
    kinds = {f.name: f.dataType for f in chunks.schema}
    out = [F.when(hit, sets[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in chunks.columns]
    return j.select(*out)


def apply_enrichment(chunks: DataFrame, results: DataFrame, model: str, at: str) -> DataFrame:
    """``chunks`` after a run at time ``at``. ``results``: chunk_id (once each), status, entities, error, error_type.

    Done chunks get their entities and are refined; skipped ones and errors get the error and stay in the queue. What an
    earlier run set and this one doesn't stays.
    """
    status, done, bad = F.col("r_status"), F.col("r_status") == DONE, F.col("r_status") != DONE
    keep = lambda when, new, old: F.when(when, new).otherwise(F.col(old))
    return _with_results(chunks, results, {
        "extracted_entities": keep(done, F.col("r_entities"), "extracted_entities"),
        "api_refined": F.when(done, F.lit(True)).when(status == SKIPPED, F.lit(False)).otherwise(F.col("api_refined")),
        "refined_at": keep(done, F.lit(at), "refined_at"),
        "refinement_model": keep(done, F.lit(model), "refinement_model"),
        "phase3_status": status,
        "phase3_error": keep(bad, F.col("r_error"), "phase3_error"),
        "phase3_error_type": keep(bad, F.col("r_error_type"), "phase3_error_type"),
        "phase3_error_at": keep(bad, F.lit(at), "phase3_error_at"),
    })


def apply_graph(chunks: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """``chunks`` after a load into the graph. ``results``: chunk_id (once each), error; null where the chunk is in."""
    fine = F.col("r_error").isNull()
    return _with_results(chunks, results, {
        "neo4j_synced": F.when(fine, F.lit(True)).otherwise(F.col("neo4j_synced")),
        "neo4j_synced_at": F.when(fine, F.lit(at)).otherwise(F.col("neo4j_synced_at")),
        "phase4_status": F.when(fine, F.lit(DONE)).otherwise(F.lit(ERROR)),
        "phase4_error": F.when(fine, F.col("phase4_error")).otherwise(F.col("r_error")),
        "phase4_error_at": F.when(fine, F.col("phase4_error_at")).otherwise(F.lit(at)),
    })


def apply_embeddings(embedded: DataFrame, results: DataFrame) -> DataFrame:
    """``embedded`` (chunk_id, embedding) with the new vectors of ``results`` in place; a failed one leaves the old, and its chunk in the queue."""
    new = results.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    return embedded.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def final_status(results: DataFrame) -> DataFrame:
    """(status, n, skipped) of a run: complete, complete_with_skipped_chunks, or error."""
    n = lambda s: F.count_if(F.col("status") == s)
    status = F.when(n(ERROR) > 0, F.lit(ERROR)).when(n(SKIPPED) > 0, F.lit("complete_with_skipped_chunks")).otherwise(F.lit("complete"))
    return results.agg(status.alias("status"), F.count(F.lit(1)).alias("n"), n(SKIPPED).alias("skipped"))


def progress(spark: SparkSession, phase: str, status: str, current: int, total: int, item: str | None, at: str, error: str | None = None) -> DataFrame:
    """One row of a phase's progress, to be appended to its table."""
    row = (phase, status, current, total, item, error, at)
    return spark.createDataFrame([row], "phase string, status string, current long, total long, item string, error string, updated_at string")


def latest_progress(rows: DataFrame) -> DataFrame:
    """The last row of each phase."""
    return rows.groupBy("phase").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "phase"]), "updated_at").alias("r")).select("phase", "r.*")
