"""Dictionary encoding: integers for keys, the same on every run."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Codes of one key range; a range's keys are numbered from 0 and must stay below this.
RANGE = 1 << 20


def encode_keys(keys: DataFrame, *, per_range: int = 30_000) -> DataFrame:
    """``(key, code)`` for each distinct non-null string in the column ``key``.

    Keys fall into hash ranges of about ``per_range`` keys, a bounded piece of work each, and
    are numbered within their range in string order: code = range * RANGE + number.  Nothing
    depends on partitions or on the order of arrival, so a recomputed task gives the same codes.
    A range would need 35 times its share of keys to leave its numbers.
    """
    distinct = keys.select("key").where("key is not null").distinct()
    ranges = max(1, ceil(keys.count() / per_range))
    placed = distinct.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    number = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    return placed.select("key", (F.col("range") * RANGE + number).alias("code"))
