"""Graphs inside tables: concept overlap, trees, chains and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stored


def concept_edges(nodes: DataFrame, id_col: str, concepts: str, *, least: int = 1, most: int | None = 5000) -> DataFrame:
    """``(id_a, id_b, weight)``: nodes sharing at least ``least`` concepts.

    An equi-join on the concept instead of comparing all pairs.  Meant for a bounded set of nodes (the graph
    view's sample); ``most`` is the view's cap on edges, in id order.
    """
    each = nodes.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(concepts)).alias("concept"))
    a, b = each.select(F.col("id").alias("id_a"), "concept"), each.select(F.col("id").alias("id_b"), "concept")
    edges = a.join(b, "concept").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    return edges if most is None else edges.orderBy("id_a", "id_b").limit(most)


def walk(edges: DataFrame, start: DataFrame, *, depth: int | None = None) -> DataFrame:
    """``(root, id, depth)``: nodes reached from every start by directed edges (src, dst), with the smallest depth of each.

    Round k adds what lies 2^k steps behind anything found so far, by pairs exactly 2^k steps apart, so the number
    of rounds grows with the log of the depth.  It ends when a round finds no new node, in cycles too; with
    ``depth``, nodes further away are left out.
    """
    jumps = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    reach = stored(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct(), "reach")
    step, known = 1, reach.count()
    while depth is None or step <= depth:
        further = reach.join(jumps, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), (F.col("depth") + step).alias("depth"))
        reach = stored(reach.unionByName(further).groupBy("root", "id").agg(F.min("depth").alias("depth")), "reach")
        before, known = known, reach.count()
        if known == before:
            break
        ahead = jumps.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
        jumps = stored(jumps.join(ahead, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")).distinct(), "edges")
        step *= 2
    return reach if depth is None else reach.where(F.col("depth") <= depth)


def chains(links: DataFrame) -> DataFrame:
    """``(id, head, position)``: where every node stands in its linked chain, counted from 0 at the head.

    ``links(id, next)`` has one row a node, with null for no next one; a next that has no row ends the chain.  Of several nodes with
    the same next one the smallest id is before it, the others' chains end there.  A ring has no head: it is opened at its smallest id.
    Pointer jumping: each round doubles the distance looked back, so rounds grow with the log of the longest chain.
    """
    nodes = links.select("id").where("id is not null").distinct()
    before = links.where("id is not null and next is not null and id <> next").groupBy(F.col("next").alias("id")).agg(F.min("id").alias("prev"))
    start = stored(nodes.join(before, "id", "left").select("id", F.col("prev").alias("far"), F.lit(1).cast("long").alias("step"), F.least("id", "prev").alias("low")), "chain")
    state, total = start, start.count()

    def ranked(state: DataFrame, rounds: int) -> DataFrame:
        """Each node's farthest node back and the way there; who still has a ``far`` after all rounds is in a ring."""
        for _ in range(rounds):
            open_ = state.where("far is not null")
            if not open_.limit(1).count():
                break
            ahead = state.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("step").alias("step2"), F.col("low").alias("low2"), F.col("head").alias("head2"))
            hopped = open_.join(ahead, "far").select("id", F.col("far2").alias("far"), (F.col("step") + F.col("step2")).alias("step"), F.least("low", "low2").alias("low"), F.col("head2").alias("head"))
            state = stored(hopped.unionByName(state.where("far is null").select("id", "far", "step", "low", "head")), "chain")
        return state

    # a node without a node before it is its own head, no step away
    begin = state.select("id", "far", F.when(F.col("far").isNull(), F.lit(0).cast("long")).otherwise(F.col("step")).alias("step"), "low", F.when(F.col("far").isNull(), F.col("id")).alias("head"))
    done = ranked(begin, total.bit_length() + 1)
    ring = done.where("far is not null")
    if ring.limit(1).count():
        cut = start.join(ring.select("id", F.col("low").alias("first")), "id").select("id", F.when(F.col("id") == F.col("first"), None).otherwise(F.col("far")).alias("far"))
        again = cut.select("id", "far", F.when(F.col("far").isNull(), 0).otherwise(1).cast("long").alias("step"), F.col("id").alias("low"), F.when(F.col("far").isNull(), F.col("id")).alias("head"))
        done = done.where("far is null").unionByName(ranked(stored(again, "chain"), total.bit_length() + 1))
    return done.select("id", "head", F.col("step").alias("position"))


def one_hop(docs: DataFrame) -> DataFrame:
    """``(id, direction, other)``: the record that replaces each one ('forward') and the records it replaces ('reverse'), both existing."""
    known = docs.select("id", "superseded_by").distinct()
    forward = known.where("superseded_by is not null").join(known.select(F.col("id").alias("superseded_by")).distinct(), "superseded_by", "left_semi")
    return forward.select("id", F.lit("forward").alias("direction"), F.col("superseded_by").alias("other")).unionByName(
        forward.select(F.col("superseded_by").alias("id"), F.lit("reverse").alias("direction"), F.col("id").alias("other"))
    )


def supersede_pairs(docs: DataFrame) -> DataFrame:
    """Replaced records beside their replacement, whose columns are null if it does not exist."""
    new = docs.select(F.col("id").alias("superseded_by"), F.col("type").alias("new_type"), F.col("source_file").alias("new_file")).distinct()
    old = docs.where("superseded_by is not null").select("id", "type", "superseded_by", "superseded_at").distinct()
    return old.join(new, "superseded_by", "left").select("id", "type", "superseded_by", "superseded_at", "new_type", "new_file")
