"""Consolidating pairwise links into groups: union-find over forests, merged in levels.

Links lie in partitions of bounded size.  Each partition runs union-find and keeps a spanning forest
only: every node tied to its tree's root.  Where several partitions know a node, their roots for it are
one component, and links between these roots are all that is left to merge; a node that is a root nowhere is
finished, and its one tie is set aside.  The links between roots are dealt to partitions again, fewer at
every level, until none is left; then the ties set aside are followed from the last level down.

No task ever holds more than its share: the number of partitions follows from the number of links at every
level, and a node with very many links is dealt to several partitions.  Roots are chosen by a scrambled number, not by
the key, so that a long chain in key order shrinks as fast as any other graph (by about a third a level or more).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.dictionary import encode_keys
from siltstone.storage import stored


def trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes, and the root (the smallest node) of each one's tree.

    Union-find with all unions of a round made at once: roots are hooked to the smallest root
    they meet, then every path is halved until flat.
    """
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return nodes, nodes[parent]


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest: nodes that are not roots, and the root of each one's tree."""
    node, root = trees(u, v)
    tied = node != root
    return node[tied], root[tied]


def _forest(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of a partition and their roots; what is held between batches is a forest, never the links."""
    u = v = np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined(find) -> tuple[np.ndarray, np.ndarray]:
        return find(np.concatenate([u, *(x for x, _ in waiting)]), np.concatenate([v, *(y for _, y in waiting)]))

    for pdf in batches:
        waiting.append((pdf["u"].to_numpy(), pdf["v"].to_numpy()))
        size += len(pdf)
        if size > max(500_000, len(u)):
            u, v = joined(local_forest)
            waiting, size = [], 0
    return joined(trees)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    node, root = _forest(batches)
    tied = node != root
    yield pd.DataFrame({"u": node[tied], "v": root[tied]})


def _ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    node, root = _forest(batches)
    yield pd.DataFrame({"node": node, "root": root})


def _dealt(links: DataFrame, parts: int, most: int) -> DataFrame:
    """Links in ``parts`` partitions, by their larger end; one with more than ``most`` smaller neighbours is split by these."""
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    links = links.select(low, high)
    if parts == 1:
        return links.repartition(1)
    # at most 2 * links / most rows, a few for each partition
    hot = links.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > most).select("v", F.ceil(F.col("n") / most).alias("pieces"))
    salted = links.join(F.broadcast(hot), "v", "left").withColumn("salt", F.pmod(F.xxhash64("u"), F.coalesce("pieces", F.lit(1))))
    return salted.repartition(parts, F.xxhash64("v", "salt")).select("u", "v")


def merge_level(links: DataFrame, parts: int, most: int) -> tuple[DataFrame, DataFrame]:
    """One level: ``ties(node, up)`` of the nodes that are finished, and the links between roots that remain."""
    held = _dealt(links, parts, most).mapInPandas(_ties, "node long, root long")
    # a node is known to as many partitions as it has been dealt to, so the list of its roots is that short
    known = stored(held.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots"), F.bool_or(F.col("node") == F.col("root")).alias("head")), "p4-known")
    up = F.col("roots")[0]
    ties = known.where(~F.col("head")).select("node", up.alias("up"))
    left = known.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), up.alias("v")).where("u <> v").distinct()
    return ties, stored(left, "p4-links")


def _turn(by: tuple[int, int], back: bool):
    """A scrambling of 64-bit numbers that can be undone: products with odd numbers and shifts by half the width."""
    first, second = (np.uint64(x) for x in by)
    half = np.uint64(32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {}
            for c in ("u", "v"):
                x = pdf[c].to_numpy(np.int64).view(np.uint64)
                if back:
                    x = x ^ (x >> half)
                x = x * first
                x = x ^ (x >> half)
                x = x * second
                out[c] = (x if back else x ^ (x >> half)).view(np.int64)
            yield pd.DataFrame(out)

    return run


_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BACK = (pow(_ODD[1], -1, 1 << 64), pow(_ODD[0], -1, 1 << 64))


def components(links: DataFrame, *, max_links: int = 1_000_000, levels: list[int] | None = None) -> DataFrame:
    """``(u, v)``: every node of a component of two or more but one, tied to that one.

    ``links`` has two long columns u and v; u = v and repeated links are allowed and change nothing, no links give no
    rows.  Which node the others are tied to depends on the component's nodes only, not on partitions or order.
    ``max_links`` bounds what one task merges (some 100 bytes a link); ``levels``, if given, gets each level's number of partitions.
    """
    spark = links.sparkSession
    scrambled = links.select("u", "v").where("u <> v").mapInPandas(_turn(_ODD, back=False), "u long, v long")
    left = stored(scrambled.mapInPandas(_links, "u long, v long"), "p4-links")
    aside: list[DataFrame] = []
    while count := left.count():
        parts = ceil(count / max_links)
        ties, left = merge_level(left, parts, max(1, max_links // 4))
        aside.append(ties)
        if levels is not None:
            levels.append(parts)
    if not aside:
        return spark.createDataFrame([], "u long, v long")

    def followed(below: DataFrame, ties: DataFrame) -> DataFrame:
        further = below.select(F.col("node").alias("up"), F.col("up").alias("top"))
        return ties.join(further, "up", "left").select("node", F.coalesce("top", "up").alias("up")).unionByName(below)

    all_ties = reduce(followed, reversed(aside[:-1]), aside[-1])
    return all_ties.select(F.col("node").alias("u"), F.col("up").alias("v")).mapInPandas(_turn(_BACK, back=True), "u long, v long")


def group_ids(links: DataFrame, a: str, b: str, **bounds) -> DataFrame:
    """``(doc_id, group_id)``: every key of a link, and the smallest key of its group in string order.

    A link with a null end is no link.  A key tied only to itself is its own group.  Repeated
    links count once, other columns are ignored, no links give no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    codes = stored(encode_keys(links.select(F.col("a").alias("key")).union(links.select("b"))), "p4-codes")
    coded = (
        links.where("a <> b")
        .join(codes.select(F.col("key").alias("a"), F.col("code").alias("u")), "a")
        .join(codes.select(F.col("key").alias("b"), F.col("code").alias("v")), "b")
        .select("u", "v")
    )
    ties = components(coded, **bounds)
    named = stored(codes.join(ties, F.col("code") == F.col("u"), "left").select("key", F.coalesce("v", "code").alias("root")), "p4-roots")
    smallest = named.groupBy("root").agg(F.min("key").alias("group_id"))
    return named.join(smallest, "root").select(F.col("key").alias("doc_id"), "group_id")
