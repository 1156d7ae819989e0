"""Traces: recorded searches that form trees (parent and children) and linked chains (previous and next).

A table of traces has ``trace_id, query, query_type, found_files, found_commits, found_issues, found_retrospectives,
found_learnings, found_resonance`` (arrays), ``file_count, commit_count, issue_count, depth, parent_trace_id,
child_trace_ids`` (array), ``prev_trace_id, next_trace_id, scope, project, session_id, agent_count, duration_ms, status,
awakening, created_at, updated_at, distilled_at``.  Every operation gives the whole new table; 'now' is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import graph, relational as rel

_FILES = ("found_files", "found_retrospectives", "found_learnings", "found_resonance")
FOUND = (*_FILES, "found_commits", "found_issues")
SCHEMA = (
    "trace_id string, query string, query_type string, " + ", ".join(f"{c} array<string>" for c in FOUND) + ", file_count int, commit_count int, issue_count int, depth int, "
    "parent_trace_id string, child_trace_ids array<string>, prev_trace_id string, next_trace_id string, scope string, project string, session_id string, agent_count int, "
    "duration_ms long, status string, awakening string, created_at long, updated_at long, distilled_at long"
)


def _sizes(cols: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.size(F.coalesce(c, F.array())) for c in cols)).cast("int")


def created(traces: DataFrame, inputs: DataFrame, now: int) -> DataFrame:
    """The table with new traces, and their ids appended to their parents' children.

    ``inputs`` has trace_id and query, and any other column of the table.  A trace is one deeper than its parent, which
    can be among the old traces or, with ``depth`` given, be made in an earlier call; an unknown parent gives depth 0.
    Counts follow from the arrays; empty scopes, types and counts get their defaults (an agent count of 0 too).
    """
    full = traces.limit(0).unionByName(inputs, allowMissingColumns=True)
    parents = traces.select(F.col("trace_id").alias("parent_trace_id"), (F.coalesce("depth", F.lit(0)) + 1).alias("__depth"))
    fresh = full.join(parents, "parent_trace_id", "left").withColumns(
        {
            "query_type": rel.filled(F.col("query_type"), F.lit("general")), "scope": rel.filled(F.col("scope"), F.lit("project")),
            "agent_count": F.coalesce(F.nullif("agent_count", F.lit(0)), F.lit(1)), "depth": F.coalesce("__depth", F.lit(0)),
            "file_count": _sizes(_FILES), "commit_count": _sizes(("found_commits",)), "issue_count": _sizes(("found_issues",)),
            "child_trace_ids": F.array().cast("array<string>"), "status": F.lit("raw"), "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long"),
            **{c: F.coalesce(c, F.array().cast("array<string>")) for c in FOUND},
        }
    ).select(*traces.columns)
    born = fresh.where("parent_trace_id is not null").groupBy(F.col("parent_trace_id").alias("trace_id")).agg(F.sort_array(F.collect_list("trace_id")).alias("__born"))
    kids = F.concat(F.coalesce("child_trace_ids", F.array().cast("array<string>")), F.coalesce("__born", F.array().cast("array<string>")))
    kept = traces.join(born, "trace_id", "left").withColumns({"updated_at": F.when(F.col("__born").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")), "child_trace_ids": kids})
    return kept.select(*traces.columns).unionByName(fresh)


def listed(traces: DataFrame, *, text: str | None = None, project: str | None = None, status: str | None = None, depth: int | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of summaries, newest first, and one row with ``total`` and ``has_more``."""
    given = [F.contains("query", F.lit(text)) if text else None, F.col("project") == project if project else None, F.col("status") == status if status else None, F.col("depth") == depth if depth is not None else None]
    hits = rel.all_of(traces, given)
    page = rel.page(hits.select(*summary(), "created_at"), [F.desc("created_at"), F.asc("trace_id")], limit, offset)
    return page, rel.has_more(hits, page, offset)


def summary() -> list[Column]:
    """Columns of a trace in a list: counts default to 0, an awakening shows as a flag."""
    return [
        F.col("trace_id"), F.col("query"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("commit_count", F.lit(0)).alias("commit_count"),
        rel.filled(F.col("status"), F.lit("raw")).alias("status"), rel.present(F.col("awakening")).alias("has_awakening"),
    ]


def linked(traces: DataFrame, links: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The table with links ``(prev_id, next_id)`` set on both sides, and every wanted link with its outcome.

    'linked', or 'missing' if a side does not exist, 'taken' if the previous trace has a next one already, or the next a
    previous one.  Links of one call that want the same side of a trace are all 'taken'.
    """
    wanted = links.select("prev_id", "next_id").distinct()
    prev = traces.select(F.col("trace_id").alias("prev_id"), F.col("next_trace_id").alias("__next"), F.lit(True).alias("__p"))
    nxt = traces.select(F.col("trace_id").alias("next_id"), F.col("prev_trace_id").alias("__prev"), F.lit(True).alias("__n"))
    once = lambda c: wanted.groupBy(c).agg((F.count("*") == 1).alias(f"__once_{c}"))
    judged = wanted.join(prev, "prev_id", "left").join(nxt, "next_id", "left").join(once("prev_id"), "prev_id", "left").join(once("next_id"), "next_id", "left")
    free = F.col("__next").isNull() & F.col("__prev").isNull() & F.col("__once_prev_id") & F.col("__once_next_id")
    outcome = F.when(F.col("__p").isNull() | F.col("__n").isNull(), "missing").when(free, "linked").otherwise("taken")
    result = judged.select("prev_id", "next_id", outcome.alias("outcome"))
    good = result.where("outcome = 'linked'")
    return _set(traces, good.select(F.col("prev_id").alias("trace_id"), F.col("next_id").alias("__to_next")), good.select(F.col("next_id").alias("trace_id"), F.col("prev_id").alias("__to_prev")), now), result


def _set(traces: DataFrame, nexts: DataFrame, prevs: DataFrame, now: int) -> DataFrame:
    """Writes links; '' clears one."""
    j = traces.join(nexts, "trace_id", "left").join(prevs, "trace_id", "left")
    put = lambda c, v: F.when(F.col(v).isNotNull(), F.nullif(v, F.lit(""))).otherwise(F.col(c))
    touched = F.col("__to_next").isNotNull() | F.col("__to_prev").isNotNull()
    return j.withColumns(
        {"next_trace_id": put("next_trace_id", "__to_next"), "prev_trace_id": put("prev_trace_id", "__to_prev"), "updated_at": F.when(touched, F.lit(now)).otherwise(F.col("updated_at"))}
    ).select(*traces.columns)


def unlinked(traces: DataFrame, ids: DataFrame, direction: str, now: int) -> DataFrame:
    """The table without the 'next' or 'prev' link of the given ``trace_id``s, on both sides; traces without one stay."""
    mine, theirs = ("next_trace_id", "__to_next") if direction == "next" else ("prev_trace_id", "__to_prev")
    other = "__to_prev" if direction == "next" else "__to_next"
    cut = traces.join(ids.select("trace_id").distinct(), "trace_id", "left_semi").where(F.col(mine).isNotNull())
    own = cut.select("trace_id", F.lit("").alias(theirs))
    back = cut.select(F.col(mine).alias("trace_id"), F.lit("").alias(other)).distinct()
    return _set(traces, own, back, now) if direction == "next" else _set(traces, back, own, now)


def distilled(traces: DataFrame, awakenings: DataFrame, now: int) -> DataFrame:
    """The table with ``awakenings(trace_id, awakening)`` written and their traces' status 'distilled'."""
    j = traces.join(awakenings.select("trace_id", F.col("awakening").alias("__new")), "trace_id", "left")
    hit = F.col("__new").isNotNull()
    put = {"status": F.lit("distilled"), "awakening": F.col("__new"), "distilled_at": F.lit(now), "updated_at": F.lit(now)}
    return j.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).select(*traces.columns)


def family(traces: DataFrame, start: DataFrame, direction: str = "both") -> DataFrame:
    """``(root, id, distance)``: ancestors (negative distance), the trace itself and descendants of every ``start.id``.

    No depth ends a walk; cycles end by themselves; links to traces that do not exist are left out.
    """
    up = traces.select(F.col("trace_id").alias("src"), F.col("parent_trace_id").alias("dst"))
    known = traces.select(F.col("trace_id").alias("id"))
    legs = []
    if direction in ("up", "both"):
        legs.append(graph.walk(up, start).select("root", "id", (-F.col("depth")).alias("distance")))
    if direction in ("down", "both"):
        legs.append(graph.walk(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select("root", "id", F.col("depth").alias("distance")))
    return reduce(lambda a, b: a.unionByName(b), legs).distinct().join(known, "id", "left_semi")


def chain_report(traces: DataFrame, start: DataFrame, direction: str = "both") -> DataFrame:
    """One row a start: ``chain`` (ids from the farthest ancestor on, equally far ones by id), ``total_depth``, ``has_awakening``, ``awakening_trace_id`` (the last in the chain)."""
    f = family(traces, start, direction).join(traces.select(F.col("trace_id").alias("id"), F.coalesce("depth", F.lit(0)).alias("depth"), rel.present(F.col("awakening")).alias("awake")), "id")
    place = F.struct("distance", "id")
    return f.groupBy("root").agg(
        F.transform(F.sort_array(F.collect_list(place)), lambda s: s["id"]).alias("chain"), F.max("depth").alias("total_depth"), F.max("awake").alias("has_awakening"),
        F.max_by("id", F.when(F.col("awake"), place)).alias("awakening_trace_id"),
    )
