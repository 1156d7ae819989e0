"""Filters, projections, sorts, aggregates and windows over the engine's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


# filters

def by_type(df: DataFrame, kind: str, col: str = "type") -> DataFrame:
    """Rows of one type; 'all' keeps everything."""
    return df if kind == "all" else df.where(F.col(col) == kind)


def in_scope(df: DataFrame, project: str | None, col: str = "project", *, lowered: bool = False) -> DataFrame:
    """Rows of a project and rows of none, which are everyone's; no project keeps everything.

    Of a table whose projects were lower-cased when it was written (``lowered``) the filter reaches the Parquet scan.
    """
    if project is None:
        return df
    own = F.col(col) if lowered else F.lower(col)
    return df.where((own == project.lower()) | F.col(col).isNull())


def after(df: DataFrame, col: str, since: int) -> DataFrame:
    """Rows strictly later than ``since``."""
    return df.where(F.col(col) > since)


def any_like(df: DataFrame, cols: list[str], word: str) -> DataFrame:
    """Rows where one of the columns contains ``word``, whose own % and _ are wildcards; case is ignored."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False)) for c in cols)))


def all_of(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """Conjunction of the conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def with_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``ids``: a semi-join; adaptive execution broadcasts a small id list."""
    return df.join(ids, on, "left_semi")


# sorting and paging

def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; the limit is clamped to 1..100."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The last row of every key by the columns ``by``; aggregates map-side, so hot keys are harmless."""
    own = df.columns
    picked = df.groupBy(key).agg(F.max(F.struct(*(F.col(c) for c in by), *(F.col(c) for c in own if c not in by and c != key))).alias("__row"))
    return picked.select(*(F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in own))


def keep_newest(df: DataFrame, family: str, name: str, keep: int) -> DataFrame:
    """Rows past the ``keep`` newest of their family: what a rotation deletes."""
    w = Window.partitionBy(family).orderBy(F.desc(name))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep)


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key, with their place counted from the end."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def sample_per_group(df: DataFrame, key: str, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of every group, chosen by a seeded hash of the id: random, but the same on every run."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= n).drop("__at")


def has_more(hits: DataFrame, page: DataFrame, offset: int) -> DataFrame:
    """One row: ``total`` hits, and whether rows are left behind the page."""
    total, rows = hits.agg(F.count("*").alias("total")), page.agg(F.count("*").alias("__rows"))
    return total.crossJoin(F.broadcast(rows)).select("total", (F.lit(max(0, offset)) + F.col("__rows") < F.col("total")).alias("has_more"))


def clamped(value: int | None, default: int, least: int, most: int) -> int:
    """A request's number within its bounds; none or zero is the default."""
    return min(most, max(least, value or default))


def enum_order(c: Column, values: list[str]) -> Column:
    """Sort key of a fixed order of values; others come last."""
    out = F.lit(len(values))
    for place, value in reversed(list(enumerate(values))):
        out = F.when(c == value, place).otherwise(out)
    return out


def in_view(df: DataFrame, view: str, col: str = "scope") -> DataFrame:
    """Rows of a view and rows for both; the view 'both' keeps everything."""
    return df if view == "both" else df.where((F.col(col) == view) | (F.col(col) == "both") | F.col(col).isNull())


# projections

def filled(c: Column, default: Column) -> Column:
    """``c``, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def present(c: Column) -> Column:
    """Whether there is a text at all."""
    return F.coalesce(c != "", F.lit(False))


# aggregates

def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, equally frequent ones by name."""
    return counts_by(df, key).orderBy(F.desc("n"), key).limit(n)


def growth(df: DataFrame, ms: Column, now: int, days: int) -> DataFrame:
    """Rows in each of ``days`` stretches of 24 hours that end at ``now``; empty ones count 0.

    One pass instead of a query a day: a row's bucket is arithmetic, and the fixed list of buckets is joined to it.
    """
    spark = df.sparkSession
    start = now - days * DAY_MS
    bucket = F.floor((ms - start) / DAY_MS).cast("int")
    counted = df.where((ms >= start) & (ms < now)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(days).select(F.col("id").cast("int").alias("bucket"))
    label = F.date_format(F.timestamp_millis(F.lit(start) + F.col("bucket").cast("long") * DAY_MS), "yyyy-MM-dd")
    return every.join(F.broadcast(counted), "bucket", "left").select("bucket", label.alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def source_mix(hits: DataFrame) -> DataFrame:
    """How many hits of a page came from text, from vectors and from both."""
    return hits.agg(*(F.count_if(F.col("source") == s).alias(s) for s in ("fts", "vector", "hybrid")))


def files_of(docs: DataFrame, path: str, order: list[str]) -> DataFrame:
    """``(file, id, type, project, created_at, concepts, chunk_ids)``: one row a file, from its first record by ``order``.

    Concepts are those of all its records in first-seen order, chunk ids all records' ids.  A file is meant to have a bounded number of records.
    """
    rows = docs.where(F.col(path).isNotNull())
    item = F.struct(*order, *(c for c in ("id", "type", "project", "created_at", "concepts") if c not in order))
    merged = rows.groupBy(F.col(path).alias("file")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = lambda c: F.col("items")[0][c].alias(c)
    union = F.array_distinct(F.flatten(F.transform("items", lambda s: F.coalesce(s["concepts"], F.array().cast("array<string>")))))
    return merged.select("file", first("id"), first("type"), first("project"), first("created_at"), union.alias("concepts"), F.transform("items", lambda s: s["id"]).alias("chunk_ids"))


def last_indexed(docs: DataFrame, path: str) -> DataFrame:
    """``(file, indexed_at, ids)``: when each file was last indexed, and its records in id order."""
    return docs.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("file")).agg(F.max("indexed_at").alias("indexed_at"), F.sort_array(F.collect_set("id")).alias("ids"))


def identity_rollup(legs: list[tuple[DataFrame, Column, Column, str]]) -> DataFrame:
    """Last seen time, actions and source of the last action of every identity over several logs.

    A leg is a frame, its identity and time columns and a name.  Each leg is aggregated before the union.
    """
    parts = [
        df.select(who.alias("identity"), at.alias("at")).where(F.col("identity").isNotNull() & (F.col("identity") != "unknown"))
        .groupBy("identity").agg(F.max("at").alias("last_seen"), F.count("*").alias("actions")).withColumn("source", F.lit(name))
        for df, who, at, name in legs
    ]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy("identity").agg(
        F.max("last_seen").alias("last_seen"), F.sum("actions").alias("actions"), F.max_by("source", F.struct("last_seen", "source")).alias("source")
    )


def thread_summary(messages: DataFrame, thread: str, order: list[str], text: str) -> DataFrame:
    """Number of messages of a thread and its last one, cut to 100 characters: one aggregation, no query a thread."""
    return messages.groupBy(thread).agg(
        F.count("*").alias("messages"), F.max_by(F.substring(text, 1, 100), F.struct(*order)).alias("last_message"), F.max(order[0]).alias("last_at")
    )


def overlaps(df: DataFrame, target: Column, source: str) -> DataFrame:
    """``(target, source, n)``: every source of a target that several sources map to, one row each."""
    pairs = df.select(F.lower(target).alias("target"), F.col(source).alias("source")).distinct()
    several = pairs.groupBy("target").agg(F.count("*").alias("n")).where("n > 1")
    return pairs.join(several, "target").select("target", "source", "n")
