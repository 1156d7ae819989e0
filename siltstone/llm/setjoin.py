"""All similar pairs between set-valued records: minhash bands, then exact verification.

Equal sets collapse to one class first, so a set that a third of all records have is compared
once.  Each class emits one row a band; classes sharing a band bucket are candidates,
candidates are made distinct, and the true overlap decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textprep import mix64
from siltstone.storage import stored


def band_keys(flat: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` bucket keys for each set; ``flat`` has the sets' hashes end to end."""
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sizes), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            for row in range(rows):
                seed = mix64(np.array([band * rows + row + 1], np.uint64))[0]
                low = np.minimum.reduceat(mix64(flat ^ seed), starts)
                keys[:, band] = mix64(keys[:, band] * np.uint64(3) + low)
    return keys.view(np.int64)


def similar_sets(
    records: DataFrame, id_col: str, terms_col: str, *, shared: int = 3, of: int = 4, min_size: int = 5, bands: int = 36, rows: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Members of each class of equal sets, and all pairs of classes that overlap enough.

    Returns ``members(id, class_id)`` and ``pairs(class_a, class_b, shared, distinct)`` where the
    shared terms are at least ``shared``/``of`` of the distinct terms of both (compared in integers).
    ``terms_col`` is an array of strings, whose null entries are dropped and repeated ones count
    once; sets smaller than ``min_size`` and rows without id take no part; repeated rows count
    once; an id with several sets is a member of several classes; other columns are ignored.
    With the defaults a pair at three quarters is missed once in 15,000.
    """
    sets = (
        records.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(terms_col, lambda t: t.isNotNull()))).alias("terms"))
        .where(F.col("id").isNotNull() & (F.size("terms") >= min_size))
        .withColumn("class_id", F.xxhash64("terms"))
    )
    members = stored(sets.select("id", "class_id").distinct(), "p7-members")
    classes = sets.groupBy("class_id").agg(F.first("terms").alias("terms"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sizes = pdf["hashes"].str.len().to_numpy()
                flat = np.concatenate(pdf["hashes"].to_numpy()).view(np.uint64)
                yield pd.DataFrame({"class_id": pdf["class_id"], "terms": pdf["terms"], "bands": list(band_keys(flat, sizes, bands, rows))})

    signed = stored(
        classes.withColumn("hashes", F.transform("terms", lambda t: F.xxhash64(t))).mapInPandas(
            hashed, "class_id long, terms array<string>, bands array<long>"
        ),
        "p7-classes",
    )
    banded = signed.select("class_id", F.explode("bands").alias("bucket"))
    one, two = banded.alias("one"), banded.alias("two")
    candidates = (
        one.join(two, "bucket")
        .where(F.col("one.class_id") < F.col("two.class_id"))
        .select(F.col("one.class_id").alias("class_a"), F.col("two.class_id").alias("class_b"))
        .distinct()
    )
    pairs = (
        candidates.join(signed.select(F.col("class_id").alias("class_a"), F.col("terms").alias("terms_a")), "class_a")
        .join(signed.select(F.col("class_id").alias("class_b"), F.col("terms").alias("terms_b")), "class_b")
        .withColumn("shared", F.size(F.array_intersect("terms_a", "terms_b")))
        .withColumn("distinct", F.size("terms_a") + F.size("terms_b") - F.col("shared"))
        .where(F.col("shared") * of >= F.col("distinct") * shared)
        .select("class_a", "class_b", "shared", "distinct")
    )
    return members, pairs
