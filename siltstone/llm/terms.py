"""Frequency of every n-gram of terms: suffix-sorted counting.

Every position of a record's term list gives one suffix, truncated to ``max_terms``.  With it go
numbers instead of record sets: how often it occurs, and for each of its prefixes whether this is
the record's first occurrence of that prefix.  These add up, so equal suffixes are combined inside each partition
before anything moves, and a suffix that a third of all records have costs one row a partition.  Suffixes are
routed by their first term (the suffixes of a hot first term by the second too), sorted in reverse
lexicographic order, and one pass with a stack gives all prefix counts of a route; a last small
sum puts the parts of split routes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stored


def _suffixes(max_terms: int, most: int = 200_000):
    """All truncated suffixes of a partition's lists, equal ones added up; up to ``most`` distinct ones are held at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[int]] = {}

        def taken() -> pd.DataFrame:
            frame = pd.DataFrame({"suffix": [list(s) for s in held], "occurrences": [n[0] for n in held.values()], **{f"first_{d}": [n[d] for n in held.values()] for d in range(1, max_terms + 1)}})
            held.clear()
            return frame

        for pdf in batches:
            for terms in pdf["terms"]:
                terms, seen = tuple(terms), set()
                for i in range(len(terms)):
                    suffix = terms[i : i + max_terms]
                    own = held.get(suffix)
                    if own is None:
                        own = held[suffix] = [0] * (max_terms + 1)
                    own[0] += 1
                    for n in range(1, len(suffix) + 1):
                        gram = suffix[:n]
                        if gram not in seen:
                            seen.add(gram)
                            own[n] += 1
                if len(held) > most:
                    yield taken()
        if held:
            yield taken()

    return run


def _stacked(max_terms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path: list[str] = []  # the prefix that is open, one entry of each counter a term
        counts: list[int] = []
        records: list[int] = []
        done: list[tuple[list[str], int, int]] = []

        def close(depth: int) -> None:
            while len(path) > depth:
                occurrences, held = counts.pop(), records.pop()
                done.append((list(path), occurrences, held))
                path.pop()
                if counts:
                    counts[-1] += occurrences  # records are kept by prefix length and need no handing down

        def taken() -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=["gram", "occurrences", "records"])
            done.clear()
            return frame

        for pdf in batches:
            firsts = pdf[[f"first_{n + 1}" for n in range(max_terms)]].to_numpy()
            for suffix, occurrences, first in zip(pdf["suffix"], pdf["occurrences"], firsts, strict=True):
                same = 0
                while same < min(len(path), len(suffix)) and path[same] == suffix[same]:
                    same += 1
                close(same)
                for term in suffix[same:]:
                    path.append(term)
                    counts.append(0)
                    records.append(0)
                counts[-1] += int(occurrences)
                for depth in range(len(suffix)):
                    records[depth] += int(first[depth])
            yield taken()
        close(0)
        yield taken()

    return run


def ngram_counts(records: DataFrame, terms_col: str, *, max_terms: int = 1, hot_share: float = 0.01) -> DataFrame:
    """``(gram, n, occurrences, records)`` for every run of at most ``max_terms`` terms.

    ``records`` has one row a record with an array of strings.  ``occurrences`` counts every
    place, ``records`` the records holding the run at least once.  Null arrays and null entries
    hold nothing, other columns are ignored, empty input gives no rows.  A first term with more
    than ``hot_share`` of all combined suffixes is split over routes by its second term.
    """
    firsts = [f"first_{n + 1}" for n in range(max_terms)]
    schema = "suffix array<string>, occurrences long, " + ", ".join(f"{c} long" for c in firsts)
    lists = records.select(F.filter(terms_col, lambda t: t.isNotNull()).alias("terms")).where(F.size("terms") > 0)
    combined = stored(lists.mapInPandas(_suffixes(max_terms), schema), "p2-suffixes")
    head, second = F.col("suffix")[0], F.try_element_at("suffix", F.lit(2))
    # terms heading very many suffixes; at most 1 / hot_share of them
    heads = combined.groupBy(head.alias("head")).agg(F.count("*").alias("n"))
    total = heads.agg(F.sum("n").alias("total"))
    hot = heads.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("total") * hot_share).select("head", F.lit(True).alias("hot"))
    routed = combined.join(F.broadcast(hot), head == F.col("head"), "left")
    routed = routed.repartition(F.xxhash64(head, F.when(F.col("hot"), F.coalesce(second, F.lit(""))))).select("suffix", "occurrences", *firsts)
    parts = routed.sortWithinPartitions(F.col("suffix").desc()).mapInPandas(_stacked(max_terms), "gram array<string>, occurrences long, records long")
    return (
        parts.groupBy("gram")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .select("gram", F.size("gram").alias("n"), "occurrences", "records")
    )


def marked_terms(counts: DataFrame, total: DataFrame, *, rare_below: int = 3, common_share: int = 10) -> DataFrame:
    """Adds ``mark``: 'rare' under ``rare_below`` records, 'common' over one in ``common_share`` of ``total.n_ids``, else null."""
    n = F.col("n_ids")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_share > n, "common")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("n_ids")
