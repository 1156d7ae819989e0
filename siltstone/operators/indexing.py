"""An index run: what is on disk becomes the table, with guards against wiping it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import merge

KEPT = ("created_at", "created_by", "origin", "project", "superseded_by", "superseded_at", "superseded_reason")


class Refused(RuntimeError):
    """An index run that would delete what it should not."""


def owned(created_by: Column | None = None) -> Column:
    """Whether the indexer made a row; what people add through other tools is never deleted."""
    by = F.col("created_by") if created_by is None else created_by
    return (by == "indexer") | by.isNull()


def collected(root_files: DataFrame, project_files: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Files of the root, all of them, then project files whose content no earlier project file has."""
    from siltstone.operators.ingest import first_of_content

    return root_files.unionByName(first_of_content(project_files, content, order), allowMissingColumns=True)


def run(indexed: DataFrame, records: DataFrame, files: DataFrame, now: int, *, source_exists: bool = True, force: bool = False, most: float = 0.5) -> DataFrame:
    """The table after a run: rows the indexer made whose file is gone are dropped, ``records`` are written by id.

    Refused, if the indexer has rows and the source folder is missing, if there is nothing to index, or if more than ``most`` of its
    rows would go (unless ``force``).  A row that comes again keeps what only people set.  ``files(source_file)`` are those on disk.
    """
    mine = indexed.where(owned())
    gone = mine.join(files.select("source_file").distinct(), "source_file", "left_anti").select("id").distinct()
    have = mine.count()
    if have and not source_exists:
        raise Refused(f"the source folder is missing, but {have} indexed rows exist")
    if have and not records.limit(1).count():
        raise Refused(f"nothing to index, but {have} indexed rows exist")
    lost = mine.join(gone, "id", "left_semi").count() if have else 0
    if have and not force and lost > most * have:
        raise Refused(f"{lost} of {have} indexed rows would be deleted")
    kept = indexed.join(gone, "id", "left_anti")
    new = indexed.limit(0).unionByName(records.withColumn("indexed_at", F.lit(now).cast("long")), allowMissingColumns=True)
    return merge.upsert(kept, new, "id", keep=[c for c in KEPT if c in indexed.columns])


def recovery(rows: DataFrame, on_disk: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """``(id, action, source)`` of rows whose file is gone: 'copy' of a file with the same name, else 'regenerate' from the indexed text, else 'unrecoverable'.

    ``rows(id, source_file, content)``, ``on_disk(source_file)``, ``elsewhere(path)``; of several candidates the first path counts.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    orphans = rows.join(on_disk.select("source_file").distinct(), "source_file", "left_anti").withColumn("__name", name(F.col("source_file")))
    found = elsewhere.groupBy(name(F.col("path")).alias("__name")).agg(F.min("path").alias("source"))
    action = F.when(F.col("source").isNotNull(), "copy").when(F.coalesce(F.trim("content") != "", F.lit(False)), "regenerate").otherwise("unrecoverable")
    return orphans.join(found, "__name", "left").select("id", action.alias("action"), "source")
