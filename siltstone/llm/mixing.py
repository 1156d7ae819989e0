"""Mixing sources to target weights: hash thresholds from token histograms.

Every record has a fixed pseudo-random 64-bit place.  Tokens are summed by source and by the
leading bits of the place; the bucket in which a source's budget ends is found on the driver from
that histogram, and only the records of this one bucket are summed again by their next bits, until
a bucket holds one place.  The places below the threshold are taken: no sorting, nothing
collected but ``buckets`` sums for each wanted source and round, and a larger budget always
takes a superset.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.keys import norm_key
from siltstone.storage import spread, stored

#: The pre-tokenizer of byte-level BPE; a fixed pattern that belongs to the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bits of a place a histogram looks at in one round.
BITS = 10


def token_counts(df: DataFrame, text: str, into: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``into``: the tokens of ``text`` under a public byte-level BPE; null text has none.

    The vocabulary file is read here and sent to the executors (about a megabyte), which need no file of their own.
    """
    with open(vocabulary, "rb") as file:
        shipped = df.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, shipped.value.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return df.withColumn(into, F.pandas_udf("long")(_typed(count))(F.col(text)))


def _typed(f):
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


@dataclass
class Part:
    """How one source is mixed: ``whole`` times everything, once more what lies below ``below``."""

    source: str
    target: float
    most: int
    budget: float = 0.0
    available: int = 0
    whole: int = 0
    below: int = 0
    short: bool = False


def _bucket(place: Column, used: int) -> Column:
    """The ``BITS`` bits of an unsigned 62-bit place after the first ``used``."""
    return F.shiftright(place, 62 - used - BITS).bitwiseAND((1 << BITS) - 1)


def _histogram(sized: DataFrame, used: int, boundary: dict[str, int] | None, wanted: list[str]) -> dict[str | None, list[tuple[int, int, int]]]:
    """Tokens and records by source and bucket, in order; under None what no wanted source has.

    With ``boundary`` only records whose first ``used`` bits are those of their source's boundary bucket.  At most
    ``2**BITS`` rows for each wanted source, and as many for the rest, come to the driver.
    """
    names = [(s, 0) for s in wanted] if boundary is None else list(boundary.items())
    known = sized.sparkSession.createDataFrame(names, "source string, prefix long")
    if boundary is None:
        rows = sized.join(F.broadcast(known.withColumnRenamed("source", "known")), F.col("source") == F.col("known"), "left").withColumn("source", F.col("known"))
    else:
        rows = sized.join(F.broadcast(known), "source").where(F.shiftright("place", 62 - used) == F.col("prefix"))
    sums = rows.groupBy("source", _bucket(F.col("place"), used).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    out: dict[str | None, list[tuple[int, int, int]]] = {}
    for row in sums.collect():
        out.setdefault(row["source"], []).append((row["bucket"], row["tokens"], row["n"]))
    return {s: sorted(buckets) for s, buckets in out.items()}


def _thresholds(sized: DataFrame, parts: list[Part]) -> int:
    """Fills in each part's passes and threshold, and gives the size of all records.

    A budget is spent on passes over the source's buckets.  Whole passes are at most ``most``; what is left ends in a bucket of the
    next pass, unless there may be none: then the source is short.  The places under ``below`` hold as many tokens as the rest allows.
    """
    wanted = [p.source for p in parts]
    first = _histogram(sized, 0, None, wanted)
    total = sum(tokens for buckets in first.values() for _, tokens, _ in buckets)
    left: dict[str, float] = {}
    for p in parts:
        p.available = sum(tokens for _, tokens, _ in first.get(p.source, []))
        p.budget = p.target * total
        p.whole = min(p.most, int(p.budget // p.available)) if p.available else p.most
        rest = p.budget - p.whole * p.available
        p.short = p.whole == p.most and (rest > 0 or (total == 0 and p.target > 0))
        if p.whole < p.most:
            left[p.source] = rest
    below = dict.fromkeys(left, 0)
    prefix = dict.fromkeys(left, 0)
    for used in range(0, 60, BITS):
        histogram = first if used == 0 else _histogram(sized, used, prefix, wanted)
        following = {}
        for s in prefix:
            threshold = (prefix[s] + 1) << (62 - used)  # all of it fits
            for bucket, tokens, n in histogram.get(s, []):
                if tokens > left[s]:
                    inner = (prefix[s] << BITS) | bucket
                    threshold = inner << (62 - used - BITS)
                    if n > 1:
                        following[s] = inner
                    break
                left[s] -= tokens
            below[s] = threshold
        prefix = following
        if not prefix:
            break
    for p in parts:
        p.below = below.get(p.source, 0)
    return total


def mix(records: DataFrame, id_col: str, text: str, source: str, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(doc_id, source, tokens, repeats)`` and the shares reached, one row a target.

    ``targets`` has source, target_share and max_repeats, at most some thousands of rows (they
    come to the driver); source names are compared trimmed and lower-cased.  The mixture is to
    be as large as all texts together.  A source is taken ``whole`` times in full and once more
    below its threshold; if even max_repeats copies of all of it are too few it is used that
    often and marked ``short``.  Repeated rows are records of their own; null sources and
    sources that no target names give only size; null texts have no tokens; other columns
    are ignored.  Of several targets of one source the one with the largest share counts; without records every share is zero and
    every target above zero is short.
    """
    spark = records.sparkSession
    counted = token_counts(spread(records.select(F.col(id_col).alias("doc_id"), norm_key(F.col(source)).alias("source"), F.col(text).alias("text"))), "text", "tokens", vocabulary)
    sized = stored(
        counted.select("doc_id", "source", "tokens", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 2).alias("place")),
        "p9-sizes",
    )
    named = targets.select(norm_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    named = named.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")
    parts = [Part(row["source"], row["target_share"] or 0.0, max(0, row["max_repeats"] or 0)) for row in named.collect()]
    total = _thresholds(sized, parts)
    schema = "source string, target_share double, max_repeats int, available long, whole int, below long, short boolean"
    plan = spark.createDataFrame([(p.source, p.target, p.most, p.available, p.whole, p.below, p.short) for p in parts], schema)
    mixture = (
        sized.join(F.broadcast(plan.select("source", "whole", "below", "max_repeats")), "source")
        .withColumn("repeats", F.least(F.col("max_repeats"), F.col("whole") + (F.col("place") < F.col("below")).cast("int")))
        .where("repeats > 0")
        .select("doc_id", "source", "tokens", "repeats")
    )
    reached = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"))
    shares = plan.join(F.broadcast(reached), "source", "left").select(
        "source", "target_share", "max_repeats", "available", F.coalesce("reached", F.lit(0).cast("long")).alias("reached"),
        F.try_divide(F.coalesce("reached", F.lit(0).cast("long")), F.lit(total)).alias("reached_share"), "short",
    )
    return mixture, shares
