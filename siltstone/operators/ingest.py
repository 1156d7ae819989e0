"""From markdown files to records: sections, bullets, concepts, content dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import front_matter_tags, keyword_concepts, merged_lists


def sections(files: DataFrame, path: str, content: str, marker: str) -> DataFrame:
    """``(path, at, title, body)`` of every section that begins with a heading ``marker`` ('##', '###').

    Text before the first heading is section 0; blank sections are dropped before numbering, sections
    without a body after it.
    """
    raw = F.filter(F.split(F.col(content), rf"(?m)^{marker}\s+"), lambda s: F.trim(s) != "")
    cut = files.select(F.col(path).alias("path"), F.posexplode(raw).alias("at", "section"))
    title = F.regexp_replace(F.substring_index("section", "\n", 1), r"^\s+|\s+$", "")  # line ends of either style fall away
    body = F.when(F.instr("section", "\n") > 0, F.regexp_replace(F.regexp_replace("section", r"^[^\n]*\n", ""), r"^\s+|\s+$", "")).otherwise("")
    return cut.select("path", "at", title.alias("title"), body.alias("body")).where("body <> ''")


def bullets(body: Column) -> Column:
    """Text of every list item."""
    return F.regexp_extract_all(body, F.lit(r"(?m)^[-*]\s+(.+)$"), 1)


def principles(files: DataFrame, path: str, content: str) -> DataFrame:
    """Records of a resonance file: one a '###' section, one more for each of its bullets."""
    whole = sections(files, path, content, "###")
    stem = F.regexp_replace("path", r"\.md", "")
    main = whole.select(F.concat_ws("_", F.lit("resonance"), stem, "at").alias("id"), F.lit("principle").alias("type"), F.concat_ws(": ", "title", "body").alias("content"))
    sub = whole.select(stem.alias("stem"), "at", "title", F.posexplode(bullets(F.col("body"))).alias("j", "item"))
    return main.unionByName(
        sub.select(F.concat_ws("_", F.lit("resonance"), "stem", "at", F.lit("sub"), "j").alias("id"), F.lit("principle").alias("type"), F.concat_ws(": ", "title", "item").alias("content"))
    )


def learnings(files: DataFrame, path: str, content: str, title: Column) -> DataFrame:
    """Records of a learning file: one a '##' section, or the whole file if it has none."""
    stem = F.regexp_replace("path", r"\.md", "")
    named = files.select(F.col(path).alias("path"), F.col(content).alias("__content"), title.alias("file_title"))
    cut = sections(named, "path", "__content", "##").where("at > 0").join(named.select("path", "file_title"), "path")
    main = cut.select(F.concat_ws("_", F.lit("learning"), stem, "at").alias("id"), F.lit("learning").alias("type"), F.concat("file_title", F.lit(" - "), "title", F.lit(": "), "body").alias("content"))
    rest = named.join(cut.select("path").distinct(), "path", "left_anti").where("trim(__content) <> ''")
    return main.unionByName(rest.select(F.concat_ws("_", F.lit("learning"), stem).alias("id"), F.lit("learning").alias("type"), F.col("__content").alias("content")))


def retrospectives(files: DataFrame, path: str, content: str, least: int = 50) -> DataFrame:
    """Records of a retrospective: its '##' sections with a body of at least ``least`` characters."""
    cut = sections(files, path, content, "##").where(F.length("body") >= least)
    return cut.select(F.concat_ws("_", F.lit("retro"), F.regexp_replace("path", r"\.md", ""), "at").alias("id"), F.lit("retro").alias("type"), F.concat("title", F.lit(": "), "body").alias("content"))


def first_of_content(files: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first file of every distinct content by ``order``; a struct minimum, so copies combine map-side."""
    others = [c for c in files.columns if c not in order]
    key = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    kept = files.groupBy(key.alias("__h")).agg(F.min(F.struct(*order, *others)).alias("__r"))
    return kept.select(*(F.col(f"__r.{c}").alias(c) for c in files.columns))


def with_concepts(records: DataFrame, content: str, source: Column | None = None) -> DataFrame:
    """Adds ``concepts``: keywords of the content, then the source file's tags."""
    tags = front_matter_tags(source) if source is not None else F.array().cast("array<string>")
    return records.withColumn("concepts", merged_lists(keyword_concepts(F.col(content)), tags))


def secrets(files: DataFrame, path: str, content: str) -> DataFrame:
    """``(path, line, kind, preview)`` of every line that shows a secret."""
    from siltstone.functions.text import secret_kind

    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\r?\n")).alias("at", "text"))
    found = lines.withColumn("kind", secret_kind(F.col("text"))).where("kind is not null")
    return found.select("path", (F.col("at") + 1).alias("line"), "kind", F.substring(F.trim("text"), 1, 120).alias("preview"))


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Place of each row among those of its key, from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
