"""References to records that do not exist, by bitmaps over a dictionary of keys.

References are first reduced to distinct (table, month, key), map-side too, so a key with a tenth
of all rows costs one row a partition.  Keys fall into hash ranges of bounded size; within a range
they are numbered in string order (the dictionary), the references of each table and month become
a compressed bitmap, and so do the existing records, those made before and after a month, and the
deleted ones.  Reference AND-NOT parent leaves the orphans, whose bits are decoded to keys and
joined back to the rows.  Only references to records made in the very month of the row need a
comparison of times.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.bitmaps import Bitmap

#: What a fact says about its key.
_REFERENCE, _PARENT, _DELETED = 0, 1, 2


def millis(c: Column, seconds_below: int = 100_000_000_000) -> Column:
    """Epoch milliseconds of a time that may be given in seconds."""
    return F.when(F.abs(c) < seconds_below, c * 1000).otherwise(c)


def month_number(ms: Column) -> Column:
    """Months since year 0 in UTC; -1 where the time is unknown."""
    at = F.timestamp_millis(ms)
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(-1))


def month_name(number: Column) -> Column:
    """'YYYY-MM' of a month number, null for -1."""
    name = F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))
    return F.when(number >= 0, name)


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The orphan references of one key range."""
    number, role = pdf["number"].to_numpy(), pdf["role"].to_numpy()
    keys = np.empty(int(number.max()) + 1, object)
    keys[number] = pdf["key"].to_numpy(object)
    month = pdf["month"].to_numpy()
    parent = role == _PARENT
    created = np.full(len(keys), -1, np.int64)
    created[number[parent]] = pdf["created"].to_numpy()[parent]
    made_in = {int(m): Bitmap.of(number[parent & (month == m)]) for m in np.unique(month[parent])}
    parents, deleted = Bitmap.of(number[parent]), Bitmap.of(number[role == _DELETED])
    table = pdf["src_table"].to_numpy(object)
    out: list[tuple] = []
    reference = role == _REFERENCE
    for name in pd.unique(table[reference]):
        own = reference & (table == name)
        for m in np.unique(month[own]):
            refs = Bitmap.of(number[own & (month == m)])
            absent = refs.and_not(parents)
            found = [("deleted", absent.and_(deleted)), ("missing", absent.and_not(deleted))]
            if m >= 0:
                after = Bitmap()
                for made, bits in made_in.items():
                    if made > m:
                        after = after.or_(refs.and_(bits))
                found += [("late", after), ("check", refs.and_(made_in.get(int(m), Bitmap())))]
            for kind, bits in found:
                hit = bits.numbers()
                if len(hit):
                    out.extend((name, m, keys[i], kind, created[i]) for i in hit.tolist())
    return pd.DataFrame(out, columns=["src_table", "month", "key", "kind", "created"])


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups the sorted rows of a partition into whole key ranges."""
    waiting: list[pd.DataFrame] = []
    for pdf in batches:
        while len(pdf):
            first = pdf["range"].iat[0]
            if waiting and waiting[0]["range"].iat[0] != first:
                yield _settle(pd.concat(waiting))
                waiting = []
            same = int((pdf["range"].to_numpy() == first).sum())
            waiting.append(pdf.iloc[:same])
            pdf = pdf.iloc[same:]
    if waiting:
        yield _settle(pd.concat(waiting))


def orphan_references(references: DataFrame, parents: DataFrame, deleted: DataFrame, *, per_range: int = 30_000) -> DataFrame:
    """``(src_table, row_id, kind, period)`` for every reference that holds no existing record.

    ``references(src_table, row_id, key, at)``, ``parents(key, created)`` and ``deleted(key)`` have
    keys spelled alike and times in epoch milliseconds.  kind is 'missing' (no parent),
    'deleted' (no parent, but in ``deleted``) or 'late' (the parent was created after ``at``; of
    several parents of a key the earliest counts).  period is the UTC month of ``at``.  A null
    key is no reference; a null ``at`` or ``created`` is never late, its period null; repeated
    rows count once; other columns are ignored; without references there are no rows.
    """
    refs = references.select("src_table", "row_id", "key", "at").where("key is not null").withColumn("month", month_number(F.col("at")))
    no_time = F.lit(None).cast("long")
    facts = (
        refs.select("src_table", "month", "key").distinct().select(F.lit(_REFERENCE).alias("role"), "src_table", "month", "key", no_time.alias("created"))
        .unionByName(
            parents.where("key is not null").groupBy("key").agg(F.min("created").alias("created"))
            .select(F.lit(_PARENT).alias("role"), F.lit("").alias("src_table"), month_number(F.col("created")).alias("month"), "key", F.coalesce("created", F.lit(-1)).alias("created"))
        )
        .unionByName(deleted.where("key is not null").select("key").distinct().select(F.lit(_DELETED).alias("role"), F.lit("").alias("src_table"), F.lit(-1).alias("month"), "key", no_time.alias("created")))
    )
    # row counts bound the number of keys; Parquet answers them from its footers
    ranges = max(1, ceil((parents.count() + deleted.count() + references.count() / 4) / per_range))
    numbered = facts.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges))).withColumn("number", F.dense_rank().over(Window.partitionBy("range").orderBy("key")) - 1)
    orphans = numbered.withColumn("created", F.coalesce("created", F.lit(-1))).mapInPandas(
        _by_range, "src_table string, month int, key string, kind string, created long"
    )
    return (
        refs.join(orphans, ["src_table", "month", "key"])
        .where((F.col("kind") != "check") | (F.col("created") > F.col("at")))
        .select("src_table", "row_id", F.when(F.col("kind") == "check", "late").otherwise(F.col("kind")).alias("kind"), month_name(F.col("month")).alias("period"))
        .distinct()
    )
