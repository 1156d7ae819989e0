"""Threads and their messages.

``threads(id, title, created_by, status, project, created_at, updated_at)`` and
``messages(thread_id, role, content, author, created_at)``.  Operations take sets of rows and give whole new tables; 'now' is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import relational as rel
from siltstone.storage import stored

#: Roles whose message leaves a thread waiting for an answer.
ASKING = ("human", "claude")


def author_label(role: Column, model: Column, project: Column) -> Column:
    """'user' for a human, else the model's name or 'claude'; with '@project' where there is one."""
    who = F.when(role == "human", "user").otherwise(rel.filled(model, F.lit("claude")))
    return F.when(rel.present(project), F.concat(who, F.lit("@"), project)).otherwise(who)


def thread_title(title: Column, message: Column, most: int = 50) -> Column:
    """The title given, or the message's first ``most`` characters, with dots if there are more."""
    return rel.filled(title, F.concat(F.substring(message, 1, most), F.when(F.length(message) > most, "...").otherwise("")))


def posted(threads: DataFrame, messages: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables with ``new(thread_id, role, content)`` written, and the messages whose thread does not exist.

    ``new`` may have title, model and project too.  A message without thread_id opens a thread: these are numbered on from the largest id, in
    the order of their content.  A thread takes the time of its last message and waits ('pending') after a role that asks.
    """
    full = threads.sparkSession.createDataFrame([], "thread_id long, role string, content string, title string, model string, project string").unionByName(new, allowMissingColumns=True)
    full = full.withColumn("author", author_label(F.col("role"), F.col("model"), F.col("project")))
    known = threads.select(F.col("id").alias("thread_id"))
    lost = full.where("thread_id is not null").join(known, "thread_id", "left_anti").select("thread_id", "role", "content")
    opening = full.where("thread_id is null").select(thread_title(F.col("title"), F.col("content")).alias("title"), "role", "content", "author", "project")
    top = threads.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    opened = _numbered(opening, ["content", "title", "author", "role", "project"]).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("__n"))
    added = full.where("thread_id is not null").join(known, "thread_id", "left_semi").select("thread_id", "role", "content", "author")
    added = added.unionByName(opened.select(F.col("id").alias("thread_id"), "role", "content", "author")).withColumn("created_at", F.lit(now).cast("long"))
    fresh = opened.select("id", "title", F.col("author").alias("created_by"), F.lit("active").alias("status"), "project", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    touched = added.groupBy(F.col("thread_id").alias("id")).agg(F.max(F.col("role").isin(*ASKING)).alias("__asks"))
    j = threads.unionByName(fresh, allowMissingColumns=True).join(touched, "id", "left")
    put = {"status": F.when(F.col("__asks"), "pending").otherwise(F.col("status")), "updated_at": F.when(F.col("__asks").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))}
    return j.withColumns(put).select(*threads.columns), messages.unionByName(added, allowMissingColumns=True), lost


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``__n`` from 1 on in the order of the columns: ranges are sorted, and each takes up where the ones before end."""
    spread_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    held = stored(spread_, "threads")
    sizes = held.groupBy("__part").agg(F.count("*").alias("size"), F.min("__row").alias("first"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part"), F.col("a.first").alias("first"))
    offsets = before.agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("__before"))  # one row a partition
    return held.join(F.broadcast(offsets), "__part").withColumn("__n", F.col("__before") + F.col("__row") - F.col("first") + 1).drop("__part", "__row", "first", "__before")


def with_status(threads: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """The table with ``changes(id, status)``; the time is moved too."""
    j = threads.join(changes.select("id", F.col("status").alias("__new")), "id", "left")
    hit = F.col("__new").isNotNull()
    return j.withColumns({"status": F.when(hit, F.col("__new")).otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).select(*threads.columns)


def full_thread(threads: DataFrame, messages: DataFrame, ids: DataFrame) -> DataFrame:
    """A row a message of the wanted ``id``s in order of time, with the thread's title and status; threads without messages have one row."""
    t = threads.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("thread_id"), "title", rel.filled(F.col("status"), F.lit("active")).alias("status"))
    return t.join(messages.select("thread_id", "role", "author", "content", "created_at"), "thread_id", "left").orderBy("thread_id", "created_at", "content")


def overview(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Every thread with its number of messages and the start of its last one, last changed first: one aggregation, no query a thread."""
    state = rel.thread_summary(messages, "thread_id", ["created_at", "content"], "content")
    return threads.withColumnRenamed("id", "thread_id").join(state, "thread_id", "left").select("thread_id", "title", "status", F.coalesce("messages", F.lit(0)).alias("messages"), "last_message", "updated_at").orderBy(F.desc("updated_at"), "thread_id")
