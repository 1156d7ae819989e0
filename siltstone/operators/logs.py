"""Logs of searches, of documents read and of things learned, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import relational as rel

SEARCH = "query string, type string, mode string, results_count int, search_time_ms long, created_at long, project string, results string"


def top_results(results: DataFrame, by: list[str], order: list[Column], most: int = 5, chars: int = 100) -> DataFrame:
    """``(*by, results_count, results)``: the number of hits and a JSON array of the first ``most``, with id, type, score and a snippet.

    ``results`` has id, type, score, content.  Only a place in the order is kept of the others, so a search with very many hits costs no memory.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    held = results.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= most)
    entry = F.struct("id", "type", "score", F.substring("content", 1, chars).alias("snippet"))
    top = held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__at", entry.alias("e")))).alias("t"))
    counts = results.groupBy(*by).agg(F.count("*").cast("int").alias("results_count"))
    return counts.join(top, by).select(*by, "results_count", F.to_json(F.transform("t", lambda s: s["e"])).alias("results"))


def search_rows(searches: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Rows of the search log: ``searches(search_id, query, type, mode, search_time_ms, project)`` with what ``results(search_id, rank, id, type, score, content)`` holds; no hits are a null list."""
    top = top_results(results, ["search_id"], [F.asc("rank"), F.asc("id")])
    j = searches.join(top, "search_id", "left")
    return j.select("search_id", "query", "type", "mode", F.coalesce("results_count", F.lit(0)).alias("results_count"), "search_time_ms", F.lit(now).cast("long").alias("created_at"), F.nullif("project", F.lit("")).alias("project"), "results")


def access_rows(results: DataFrame, kind: str, now: int) -> DataFrame:
    """One row of the access log for every hit."""
    return results.select(F.col("id").alias("document_id"), F.lit(kind).alias("access_type"), F.lit(now).cast("long").alias("created_at"), "project")


def learn_rows(learned: DataFrame, now: int, most: int = 100, default_source: str = "learn") -> DataFrame:
    """Rows of the learn log: the start of each pattern, its source or the default, its concepts as JSON."""
    return learned.select(
        F.col("id").alias("document_id"), F.substring("pattern", 1, most).alias("pattern_preview"), rel.filled(F.col("source"), F.lit(default_source)).alias("source"),
        F.to_json(F.coalesce("concepts", F.array().cast("array<string>"))).alias("concepts"), F.lit(now).cast("long").alias("created_at"), "project",
    )


def search_totals(log: DataFrame) -> DataFrame:
    """Searches, their mean time and all their results."""
    return log.agg(F.count("*").alias("searches"), F.round(F.avg("search_time_ms"), 4).alias("avg_ms"), F.coalesce(F.sum("results_count"), F.lit(0)).alias("results"))


def recent(log: DataFrame, n: int, *tie: str) -> DataFrame:
    """The last ``n`` rows, newest first."""
    return log.orderBy(F.desc("created_at"), *tie).limit(n)
