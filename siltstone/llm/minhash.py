"""Near-duplicate records by b-bit MinHash.

Each distinct text is sketched once: its character windows are hashed, the hashes dealt to
``bands * rows`` bins, and the smallest hash of each bin kept (one permutation; an empty bin
borrows from a fixed pseudo-random sequence of others).  Only the low eight bits of each
minimum are retained, four to an integer, so a sketch of 200 minima takes 200 bytes and each
integer is at once one band of four rows.  Texts sharing a band are candidates; the
similarity is estimated from the number of equal low bits, corrected for the 1/256 that
agree by chance; what stays is compared exactly.

At scale: texts are sketched where they are read, and copies of a text collapse to one sketch before anything is paired, with a
map-side step, so a text that makes up a third of all rows costs one row a partition.  The
largest shuffle holds ``bands`` pairs of numbers for each distinct text; only texts that have a likely partner move themselves,
for the exact comparison.  A band that many different texts share is a skewed join key that adaptive execution splits.
Classes are named by 64-bit hashes: among ten billion distinct texts about three pairs would share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textprep import code_points, mix64, slices, window_hashes, windows_of
from siltstone.storage import stored

#: Low bits kept of a minimum, and how many such values one integer holds.
BITS, PER_INT = 8, 4


def normal_text(c: Column) -> Column:
    """Lower case, each run of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def sketch(texts: list[str], k: int, bands: int) -> np.ndarray:
    """One row of ``bands`` integers for each text: the low bits of its bins' minima."""
    bins = bands * PER_INT
    points, lengths = code_points(texts)
    at, owner = windows_of(lengths, k)
    hashes = window_hashes(points, k)[at]
    n = len(texts)
    low = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    # the upper half of a hash chooses the bin, the scrambled hash competes in it
    cell = owner * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(low, cell, mix64(hashes))
    low = low.reshape(n, bins)
    empty = low == np.iinfo(np.uint64).max
    filled = ~empty
    some = filled.any(axis=1)
    row, col = np.nonzero(empty & some[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix64((col.astype(np.uint64) << np.uint64(20)) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = filled[row, source]
        low[row[ok], col[ok]] = low[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    return (low & np.uint64(255)).astype(np.uint8).view(np.int32)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sketches row by row, corrected for low bits that agree by chance."""
    different = a.view(np.uint8) ^ b.view(np.uint8)
    equal = 1 - np.count_nonzero(different, axis=1) / different.shape[1]
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def window_jaccard(a: str, b: str, k: int) -> float:
    """Exact share of distinct windows of ``k`` characters that two texts have in common."""
    x = {a[i : i + k] for i in range(len(a) - k + 1)}
    y = {b[i : i + k] for i in range(len(b) - k + 1)}
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared) if x or y else 0.0


def near_duplicates(
    records: DataFrame,
    id_col: str,
    text_col: str,
    *,
    threshold: float = 0.6,
    k: int = 16,
    min_chars: int = 200,
    bands: int = 50,
    slack: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """Members of each class of equal texts, and all pairs of similar classes.

    Returns ``members(id, class_id)``, one row for each record that counts, and
    ``pairs(class_a, class_b, similarity)`` with class_a < class_b and an exact similarity of at
    least ``threshold``.  A class is a normalised text, named by its 64-bit hash.  A pair is
    missed if none of ``bands`` bands of four minima agree: at similarity 0.6 once in a
    thousand, at 0.7 less than once in a million.  ``slack`` is how far below the threshold an
    estimate may lie (five standard errors) before the exact comparison is skipped.

    Null, blank and short texts (under ``min_chars`` after normalising) take no part; a null id
    takes no part; repeated rows count once; an id with several texts is a member of several
    classes.  Other columns are ignored.  Empty input gives empty results.
    """
    base = (
        records.select(F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("text"))
        .where(F.col("id").isNotNull() & (F.length("text") >= max(min_chars, k)))
        .select("id", "text", F.xxhash64("text").alias("class_id"))
    )

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = np.flatnonzero(~pdf["class_id"].duplicated().to_numpy())  # copies in one batch are sketched once
            texts = pdf["text"].to_numpy()[new].tolist()
            sigs = np.full(len(pdf), None, object)
            for lo, hi in slices(texts, 1000):
                sigs[new[lo:hi]] = list(sketch(texts[lo:hi], k, bands))
            yield pd.DataFrame({"id": pdf["id"], "class_id": pdf["class_id"], "sig": sigs})

    # texts are sketched where they are read; what moves is an id, a number and 200 bytes, never a text
    kind = base.schema["id"].dataType.simpleString()
    sketched = stored(base.mapInPandas(sketches, f"id {kind}, class_id long, sig array<int>"), "p1-records")
    members = stored(sketched.select("id", "class_id").distinct(), "p1-members")
    sigs = stored(sketched.where("sig is not null").groupBy("class_id").agg(F.first("sig").alias("sig")), "p1-sketches")
    banded = sigs.select("class_id", F.posexplode("sig").alias("band", "value"))
    one, two = banded.alias("one"), banded.alias("two")
    candidates = (
        one.join(two, ["band", "value"])
        .where(F.col("one.class_id") < F.col("two.class_id"))
        .select(F.col("one.class_id").alias("class_a"), F.col("two.class_id").alias("class_b"))
        .distinct()
    )
    both = (
        candidates.join(sigs.select(F.col("class_id").alias("class_a"), F.col("sig").alias("sig_a")), "class_a")
        .join(sigs.select(F.col("class_id").alias("class_b"), F.col("sig").alias("sig_b")), "class_b")
    )
    floor = threshold - slack

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                keep = estimate(np.stack(pdf["sig_a"].to_numpy()), np.stack(pdf["sig_b"].to_numpy())) >= floor
                yield pdf.loc[keep, ["class_a", "class_b"]]

    likely_pairs = stored(both.mapInPandas(likely, "class_a long, class_b long"), "p1-likely")
    wanted = likely_pairs.select(F.col("class_a").alias("class_id")).union(likely_pairs.select("class_b")).distinct()
    texts = stored(base.join(wanted, "class_id", "left_semi").groupBy("class_id").agg(F.first("text").alias("text")), "p1-texts")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = [window_jaccard(a, b, k) for a, b in zip(pdf["text_a"], pdf["text_b"], strict=True)]
            out = pdf[["class_a", "class_b"]].assign(similarity=np.asarray(score, float))
            yield out[out["similarity"] >= threshold]

    pairs = (
        likely_pairs.join(texts.select(F.col("class_id").alias("class_a"), F.col("text").alias("text_a")), "class_a")
        .join(texts.select(F.col("class_id").alias("class_b"), F.col("text").alias("text_b")), "class_b")
        .mapInPandas(exact, "class_a long, class_b long, similarity double")
    )
    return members, pairs


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of different ids, smaller first: between similar classes and within a class."""
    a = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    across = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where(F.col("x") < F.col("y")).select("x", "y")
    return (
        across.unionByName(within)
        .where(F.col("x") != F.col("y"))
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )
