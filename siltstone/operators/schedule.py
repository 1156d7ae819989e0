"""Appointments: adding, changing, listing, and their markdown."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.dates import parsed_date
from siltstone.operators import relational as rel
from siltstone.storage import stored

SCHEMA = "id long, date string, date_raw string, time string, event string, notes string, recurring string, status string, created_at long, updated_at long"
_TABLE = "| Date | Time | Event | Notes |\n|------|------|-------|-------|\n"
_RECURRING = "| Day | Time | Event |\n|-----|------|-------|\n"


def added(table: DataFrame, new: DataFrame, today: str, now: int) -> DataFrame:
    """The table with ``new(id, date, event)`` and any of time, notes, recurring; dates as people write them. Rows without a date or an event are an error of the caller and are left out."""
    full = new.sparkSession.createDataFrame([], "id long, date string, event string, time string, notes string, recurring string").unionByName(new, allowMissingColumns=True)
    good = full.where(rel.present(F.trim("date")) & rel.present(F.trim("event")))
    blank = lambda c: F.nullif(c, F.lit("")).alias(c)
    rows = good.select(
        "id", parsed_date(F.col("date"), today).alias("date"), F.col("date").alias("date_raw"), blank("time"), "event", blank("notes"), blank("recurring"), F.lit("pending").alias("status"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"),
    )
    # parsed once: a date's expression is long, and every filter or group would repeat it
    return table.unionByName(stored(rows, "schedule"))


def changed(table: DataFrame, patch: DataFrame, now: int) -> DataFrame:
    """The table with a patch: ``id`` and any columns of the table; a null leaves a value as it is."""
    cols = [c for c in patch.columns if c != "id" and c in table.columns]
    j = table.join(patch.select("id", *(F.col(c).alias(f"__{c}") for c in cols), F.lit(True).alias("__hit")), "id", "left")
    put = {c: F.coalesce(f"__{c}", c) for c in cols} | {"updated_at": F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("updated_at"))}
    return j.withColumns(put).select(*table.columns)


def listed(table: DataFrame, today: str, *, status: str = "pending", day: str | None = None, since: str | None = None, until: str | None = None, word: str | None = None, limit: int = 50) -> DataFrame:
    """Appointments in order of date and time, those without a time first; without dates those of today and the next 14 days."""
    rows = table if status == "all" else table.where(F.col("status") == status)
    spark_date = lambda d: parsed_date(F.lit(d), today)
    if day:
        rows = rows.where(F.col("date") == spark_date(day))
    else:
        last = (date.fromisoformat(today) + timedelta(days=14)).isoformat()
        rows = rows.where(F.col("date").between(spark_date(since) if since else F.lit(today), spark_date(until) if until else F.lit(last)))
    if word:
        rows = rel.any_like(rows, ["event", "notes"], word)
    return rows.orderBy("date", F.asc_nulls_first("time"), "id").limit(limit)


def markdown(table: DataFrame) -> DataFrame:
    """``(section, body)``: a table a month of what is pending, and one of what recurs; a section's text must fit one row."""
    open_ = table.where("status = 'pending'")
    time, recur = rel.filled(F.col("time"), F.lit("TBD")), F.when(rel.present(F.col("recurring")), F.concat(F.lit(" ("), "recurring", F.lit(")"))).otherwise("")
    row = F.concat(F.lit("| "), F.coalesce("date_raw", "date"), F.lit(" | "), time, F.lit(" | "), "event", recur, F.lit(" | "), F.coalesce("notes", F.lit("")), F.lit(" |\n"))
    again = F.concat(F.lit("| "), "recurring", F.lit(" | "), time, F.lit(" | "), "event", F.lit(" |\n"))

    def sections(df: DataFrame, name, head: str, line, title) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct("date", F.coalesce("time", F.lit("")).alias("t"), "id", line.alias("line"))))
        text = F.concat(F.lit("## "), title, F.lit("\n\n" + head), F.array_join(F.transform(items, lambda s: s["line"]), ""))
        return df.groupBy(name.alias("section")).agg(text.alias("body"))

    months = sections(open_, F.substring("date", 1, 7), _TABLE, row, F.date_format(F.first(F.to_date(F.concat(F.substring("date", 1, 7), F.lit("-01")))), "MMMM yyyy"))
    return months.unionByName(sections(open_.where(rel.present(F.col("recurring"))), F.lit("recurring"), _RECURRING, again, F.lit("Recurring")))
