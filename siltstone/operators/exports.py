"""Renderings of tables as markdown, hubs and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import dates, markup, text
from siltstone.functions.text import glob_regex


def joined_lines(rows: DataFrame, key: str, line: Column, order: list[str]) -> DataFrame:
    """``(key, page, n, body)``: all of a group's lines in order, joined by line ends; page is always 0, n is the group's size.

    One row a group whatever its size, so a group's text must fit one task.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    body = F.array_join(F.transform(items, lambda s: s["__line"]), "\n")
    return rows.groupBy(key).agg(F.lit(0).alias("page"), F.count("*").alias("n"), body.alias("body"))


def schedule_markdown(events: DataFrame, day: str, what: str) -> DataFrame:
    """A month's heading and its events, one line each."""
    lines = joined_lines(events.withColumn("month", F.substring(day, 1, 7)), "month", F.concat(F.lit("- "), F.col(day), F.lit(": "), F.col(what)), [day, what])
    return lines.select("month", "page", F.concat(F.lit("## "), "month", F.lit("\n"), "body").alias("markdown"))


def index_markdown(docs: DataFrame, group: str, title: str, path: str) -> DataFrame:
    """A group's heading with its number of records and a link to each."""
    lines = joined_lines(docs, group, F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(path), F.lit(")")), [title, path])
    return lines.select(group, "page", F.concat(F.lit("## "), F.col(group), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "body").alias("markdown"))


def first_match(names: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """The first pattern of every name: ``patterns(ord, pattern, service)`` with exact names, 'x*' and 'x/**'.

    The pattern list is a configuration of some rows; it comes to the driver and becomes one expression.
    """
    out = F.lit(None).cast("string")
    for row in sorted(patterns.collect(), key=lambda r: r["ord"], reverse=True):
        regex = glob_regex(row["pattern"].replace("/**", "/*")) if "*" in row["pattern"] else None
        hit = F.col(name).rlike(regex) if regex else F.col(name) == row["pattern"]
        out = F.when(hit, row["service"]).otherwise(out)
    return names.select(name, out.alias("service"))


def tree(items: DataFrame, key: str, parent: str) -> DataFrame:
    """Every item with its parent, or as a root if the parent does not exist, and its number of children."""
    known = items.select(F.col(key).alias("__p")).distinct()
    placed = items.join(known, F.col(parent) == F.col("__p"), "left").withColumn("parent_id", F.col("__p"))
    kids = placed.where("parent_id is not null").groupBy(F.col("parent_id").alias("__k")).agg(F.count("*").alias("children"))
    return placed.join(kids, F.col(key) == F.col("__k"), "left").select(key, "parent_id", F.coalesce("children", F.lit(0)).alias("children"))


def vault_files(docs: DataFrame, links: DataFrame) -> DataFrame:
    """``(path, content)`` of a vault: a file a record with front matter and its similar records, a hub a concept, and an index a type.

    ``docs(id, type, title, content, concepts array, project, created_at)``, one row an id; ``links(id, other, score)`` of similar records.
    """
    name = text.slug_runs(F.concat_ws(" ", "title", "id"), 80)
    named = docs.withColumn("path", F.concat_ws("/", "type", F.concat(name, F.lit(".md"))))
    near = links.join(named.select(F.col("id").alias("other"), F.col("title").alias("__title"), F.col("path").alias("__path")), "other").groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "other", F.concat(F.lit("- ["), "__title", F.lit("]("), "__path", F.lit(")")).alias("line")))), lambda s: s["line"]), "\n").alias("__related")
    )
    head = markup.rendered_front_matter(id=F.col("id"), type=F.col("type"), project=F.col("project"), created=dates.day_of(F.col("created_at")))
    related = F.when(F.col("__related").isNotNull(), F.concat(F.lit("\n\n## Related\n\n"), "__related")).otherwise("")
    records = named.join(near, "id", "left").select("path", F.concat(head, F.lit("\n# "), "title", F.lit("\n\n"), F.coalesce("content", F.lit("")), related, F.lit("\n")).alias("content"))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("path"), F.lit(")"))
    each = named.select(F.explode(F.array_distinct("concepts")).alias("concept"), "created_at", "id", "title", "path")
    hubs = joined_lines(each.withColumn("__late", -F.col("created_at")), "concept", line, ["__late", "id"])
    hubs = hubs.select(F.concat(F.lit("_concepts/"), text.slug_runs(F.col("concept"), 80), F.lit("-"), markup.short_hash(F.col("concept")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "concept", F.lit("\n\n"), "body", F.lit("\n")).alias("content"))
    index = index_markdown(named, "type", "title", "path").select(F.concat("type", F.lit("/_index.md")).alias("path"), F.col("markdown").alias("content"))
    return records.unionByName(hubs).unionByName(index)
