"""The indexing queue as a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enqueue(docs: DataFrame, models: DataFrame, created_at: int) -> DataFrame:
    """One pending job for every document and model; the model registry is a handful of rows and broadcast."""
    return docs.crossJoin(F.broadcast(models)).select("doc_id", "model_key", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(created_at).alias("created_at"))


def claim_next(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` oldest pending jobs of every model, with one attempt more."""
    w = Window.partitionBy("model_key").orderBy("created_at", "id")
    pending = jobs.where(F.col("status") == "pending").distinct()
    return pending.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= n).withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("claimed")).drop("__at")


def finished(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """The table with ``outcomes(id, error)`` written: done without an error text, which clears an old one, else error; the row and its attempts stay."""
    j = jobs.join(outcomes.select("id", F.col("error").alias("__error"), F.lit(True).alias("__hit")), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    put = {"status": F.when(F.col("__error").isNull(), "done").otherwise("error"), "finished_at": F.lit(now).cast("long"), "error": F.col("__error")}
    return j.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).select(*jobs.columns)


def reclaimed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with claimed jobs among ``ids`` pending again, as after a crash; jobs in any other state stay."""
    j = jobs.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("status") == "claimed")
    return j.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "claimed_at": F.when(hit, None).otherwise(F.col("claimed_at"))}).select(*jobs.columns)


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the pending jobs among ``ids``; what is claimed or finished stays."""
    wanted = ids.select("id").distinct().withColumn("status", F.lit("pending"))
    return jobs.join(wanted, ["id", "status"], "left_anti").select(*jobs.columns)


def worked(claimed: DataFrame, docs: DataFrame, failed: DataFrame) -> DataFrame:
    """``(id, model_key, doc_id, text, event)`` of claimed jobs: 'doc_missing' where the document is gone, which counts as done, 'error' where ``failed(id, error)`` has it, else 'done'.

    ``docs(doc_id, text)`` has one row a document.  One model's failures leave the others' jobs alone.
    """
    j = claimed.select("id", "model_key", "doc_id").join(docs.select("doc_id", "text", F.lit(True).alias("__known")), "doc_id", "left").join(failed.select("id", "error"), "id", "left")
    event = F.when(F.col("__known").isNull(), "doc_missing").when(F.col("error").isNotNull(), "error").otherwise("done")
    return j.select("id", "model_key", "doc_id", "text", event.alias("event"), F.when(F.col("__known").isNotNull(), F.col("error")).alias("error"))


def progress(state: DataFrame, now: int) -> DataFrame:
    """Status of index runs with documents a second and the seconds left.

    ``state(id, is_indexing, progress_current, progress_total, started_at, error)``.
    """
    elapsed = (F.lit(now) - F.col("started_at")) / 1000.0
    rate = F.when((elapsed > 0) & (F.col("progress_current") > 0), F.round(F.col("progress_current") / elapsed, 1)).otherwise(F.lit(0.0))
    left = F.col("progress_total") - F.col("progress_current")
    status = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("is_indexing"), "indexing")
        .when((F.col("progress_current") >= F.col("progress_total")) & (F.col("progress_total") > 0), "completed").otherwise("idle")
    )
    return state.select("id", status.alias("status"), "progress_current", "progress_total", rate.alias("docs_per_second"), F.when(rate > 0, F.ceil(left / rate)).otherwise(0).alias("eta"))


def status_row(state: DataFrame, indexing: bool, current: int, total: int, now: int, error: str | None = None) -> DataFrame:
    """The status table after a run moves on: a start is noted once, an end only when the run stops."""
    put = {
        "is_indexing": F.lit(indexing), "progress_current": F.lit(current), "progress_total": F.lit(total), "error": F.lit(error).cast("string"),
        "started_at": F.coalesce("started_at", F.lit(now)) if indexing else F.col("started_at"), "completed_at": F.lit(None if indexing else now).cast("long"),
    }
    return state.withColumns(put).select(*state.columns)


def depth(jobs: DataFrame) -> DataFrame:
    """Jobs of every model by state, and how many wait or run."""
    return jobs.groupBy("model_key").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "claimed", "done", "error")), F.count_if(F.col("status").isin("pending", "claimed")).alias("depth")
    )
