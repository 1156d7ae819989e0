"""Merging snapshots: upserts, plans, verification, stale rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import project_of_source


def upsert(old: DataFrame, new: DataFrame, key: str, *, keep: list[str]) -> DataFrame:
    """The table after ``new`` is written over ``old``: columns in ``keep`` stay those of an existing row.

    One full outer join on the key; both sides have one row a key.
    """
    cols = [c for c in old.columns if c != key]
    o = old.select(key, *(F.col(c).alias(f"__o_{c}") for c in cols), F.lit(True).alias("__old"))
    n = new.select(key, *(F.col(c).alias(f"__n_{c}") for c in cols), F.lit(True).alias("__new"))
    j = o.join(n, key, "full_outer")
    had, comes = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    pick = lambda c: F.when(comes & (~had if c in keep else F.lit(True)), F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}"))
    return j.select(key, *(pick(c).alias(c) for c in cols))


def append_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks."""
    return new.join(old.select(key), key, "left_anti")


def stale(indexed: DataFrame, disk: DataFrame, path: str, *, owned: Column, most: float = 0.5) -> DataFrame:
    """Indexed rows whose file is gone, with ``allowed``: whether their share stays within the guard.

    Only rows that ``owned`` says the indexer made are looked at; above ``most`` of them nothing may be deleted.
    The guards against a missing folder and an empty collection are those of :func:`siltstone.operators.indexing.run`.
    """
    mine = indexed.where(owned)
    gone = mine.join(disk.select(path).distinct(), path, "left_anti")
    share = gone.agg(F.count("*").alias("g")).crossJoin(mine.agg(F.count("*").alias("m")))
    return gone.crossJoin(F.broadcast(share.select((F.col("g") <= F.col("m") * most).alias("allowed"))))


def verify(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(path, status)``: healthy, drifted, missing, orphaned or untracked.

    ``disk(path, mtime, tracked)`` and ``indexed(path, indexed_at)``, one row a path each.
    """
    j = disk.withColumn("__d", F.lit(True)).join(indexed.withColumn("__i", F.lit(True)), "path", "full_outer")
    status = (
        F.when(F.col("__d").isNull(), "orphaned")
        .when(F.col("__i").isNull() & F.col("tracked"), "missing").when(F.col("__i").isNull(), "untracked")
        .when(F.col("mtime") > F.col("indexed_at"), "drifted").otherwise("healthy")
    )
    return j.select("path", status.alias("status"))


def import_plan(docs: DataFrame, state: DataFrame) -> DataFrame:
    """``(id, action)``: create, update, skip-unchanged, skip-no-id, or tombstone for what is gone.

    ``docs(id, hash)`` and ``state(id, hash)``.
    """
    s = state.select("id", F.col("hash").alias("__was"))
    live = docs.join(s, "id", "left").select(
        "id", F.when(F.col("id").isNull(), "skip-no-id").when(F.col("__was").isNull(), "create").when(F.col("hash") == F.col("__was"), "skip-unchanged").otherwise("update").alias("action")
    )
    gone = state.join(docs.where("id is not null").select("id"), "id", "left_anti").select("id", F.lit("tombstone").alias("action"))
    return live.unionByName(gone)


def apply_plan(docs: DataFrame, plan: DataFrame, imported: DataFrame, now: int) -> DataFrame:
    """The table after an import: planned updates change the columns they bring, planned creations are added; nothing is deleted.

    ``plan(id, action)`` as :func:`import_plan` gives it, ``imported`` has id and columns of the table.  A tombstone only warns.
    """
    wanted = plan.where(F.col("action").isin("update", "create")).select("id", "action").distinct()
    rows = imported.join(wanted, "id")
    changes = rows.where("action = 'update'").drop("action")
    fresh = rows.where("action = 'create'").drop("action").withColumns({c: F.lit(now).cast("long") for c in ("created_at", "updated_at", "indexed_at") if c in docs.columns})
    return patched(docs, changes, now).unionByName(docs.limit(0).unionByName(append_absent(docs, fresh, "id"), allowMissingColumns=True))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def merged_state(prior: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, path, hash)`` of a vault after an import: entries of imported records are new, all others stay; records without id have none."""
    fresh = docs.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("path", "hash")).alias("r")).select("id", "r.path", "r.hash")
    return prior.join(fresh.select("id"), "id", "left_anti").select("id", "path", "hash").unionByName(fresh)


def patched(docs: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """The table with ``changes``: id and any columns; a null leaves a value, concepts are lower-cased and made distinct, unknown ids change nothing."""
    cols = [c for c in changes.columns if c != "id" and c in docs.columns]
    j = docs.join(changes.select("id", *(F.col(c).alias(f"__{c}") for c in cols), F.lit(True).alias("__hit")), "id", "left")
    fresh = {c: F.array_distinct(F.transform(F.filter(f"__{c}", lambda x: x.isNotNull() & (x != "")), F.lower)) if c == "concepts" else F.col(f"__{c}") for c in cols}
    put = {c: F.coalesce(v, F.col(c)) for c, v in fresh.items()}
    put |= {c: F.when(F.col("__hit"), F.lit(now)).otherwise(F.col(c)) for c in ("updated_at", "indexed_at") if c in docs.columns}
    return j.withColumns(put).select(*docs.columns)


def inserted(docs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the rows of ``new`` whose id it lacks, and the ids that exist already (a conflict of the caller)."""
    return docs.unionByName(append_absent(docs, new, "id"), allowMissingColumns=True), new.join(docs.select("id"), "id", "left_semi").select("id")


def superseded(docs: DataFrame, pairs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The table with ``pairs(old_id, new_id, reason)`` written on the old records, and the log rows; pairs with an unknown side or an id replacing itself are left out.

    Of several pairs for one record the smallest new id counts.
    """
    known = docs.select("id").distinct()
    good = pairs.where("old_id <> new_id").join(known.withColumnRenamed("id", "old_id"), "old_id", "left_semi").join(known.withColumnRenamed("id", "new_id"), "new_id", "left_semi")
    one = good.groupBy("old_id").agg(F.min(F.struct("new_id", "reason")).alias("p")).select("old_id", "p.new_id", "p.reason")
    j = docs.join(one.select(F.col("old_id").alias("id"), F.col("new_id").alias("__new"), F.col("reason").alias("__reason")), "id", "left")
    hit = F.col("__new").isNotNull()
    put = {"superseded_by": F.col("__new"), "superseded_at": F.lit(now).cast("long"), "superseded_reason": F.col("__reason")}
    return j.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).select(*docs.columns), one.withColumn("superseded_at", F.lit(now).cast("long"))


def repaired_projects(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, project, found_in)`` of records without a project whose file, or else whose indexed text, names one.

    ``docs(id, source_file, content, project)``, ``files(source_file, content)``.
    """
    lacking = docs.where(~F.coalesce(F.col("project") != "", F.lit(False))).select("id", "source_file", "content").distinct()
    own = files.groupBy("source_file").agg(F.min("content").alias("__file"))
    j = lacking.join(own, "source_file", "left").select("id", project_of_source(F.col("__file")).alias("__f"), project_of_source(F.col("content")).alias("__c"))
    found = j.select("id", F.coalesce("__f", "__c").alias("project"), F.when(F.col("__f").isNotNull(), "file").otherwise("index").alias("found_in")).where("project is not null")
    return found.groupBy("id").agg(F.min(F.struct("found_in", "project")).alias("r")).select("id", "r.project", "r.found_in")


def settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """A key-value table with the keys of ``new(key, value)`` replaced."""
    return upsert(old.select("key", "value"), new.select("key", "value"), "key", keep=[])


def seeded(old: DataFrame, seed: DataFrame, key: list[str], now: int) -> tuple[DataFrame, DataFrame]:
    """A table after a seed is merged, and each seed row's outcome: 'inserted', 'updated', 'unchanged', or 'preserved' where people changed or made the row.

    ``old`` has ``source`` ('seed' for rows that a seed made) and ``touched_at``, null while nobody changed the row; keys compare nulls as equal.
    """
    cols = [c for c in seed.columns if c not in key]
    o = old.select(*(F.col(c).alias(f"__k_{c}") for c in key), *(F.col(c).alias(f"__o_{c}") for c in cols), F.col("source").alias("__source"), F.col("touched_at").alias("__touched"), F.lit(True).alias("__old"))
    same_key = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in cols))
    free = F.coalesce(F.col("__source") == "seed", F.lit(False)) & F.col("__touched").isNull()
    outcome = F.when(F.col("__old").isNull(), "inserted").when(~free, "preserved").when(differs, "updated").otherwise("unchanged")
    judged = seed.join(o, same_key, "left").select(*seed.columns, outcome.alias("outcome"))
    wins = judged.where(F.col("outcome").isin("inserted", "updated"))
    w = wins.select(*(F.col(c).alias(f"__k_{c}") for c in key), *(F.col(c).alias(f"__n_{c}") for c in cols), F.col("outcome").alias("__outcome"))
    put = {c: F.when(F.col("__outcome").isNotNull(), F.col(f"__n_{c}")).otherwise(F.col(c)) for c in cols}
    if "updated_at" in old.columns:
        put["updated_at"] = F.when(F.col("__outcome").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    kept = old.join(w.where("__outcome = 'updated'"), same_key, "left").withColumns(put).select(*old.columns)
    fresh = wins.where("outcome = 'inserted'").drop("outcome").withColumns({"source": F.lit("seed")} | {c: F.lit(now).cast("long") for c in ("created_at", "updated_at") if c in old.columns})
    return kept.unionByName(old.limit(0).unionByName(fresh, allowMissingColumns=True)), judged.select(*key, "outcome")


def unique_slugs(df: DataFrame, slug: str, order: list[str], suffix: Column) -> DataFrame:
    """The first row of a slug keeps it, later ones get a suffix."""
    at = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return df.withColumn("__at", at).withColumn(slug, F.when(F.col("__at") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, suffix))).drop("__at")
