"""Readers: markdown trees, feed logs, inbox folders, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dates import file_timestamp

FEED = ("timestamp", "oracle", "host", "event", "project")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """``(path, modified, size, content)`` of every .md file below ``path``; dot folders, node_modules and generated indexes are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    out = files.select(
        F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content")
    )
    return out.where(~F.col("path").rlike(r"/(\.[^/]+|node_modules|_concepts)/|/_index\.md$"))


def file_stats(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``(path, modified, size)`` without reading contents: the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"))


def feed_fields(line: Column) -> list[Column]:
    """Columns of a feed line 'time | who | host | event | project | session » message'."""
    parts = F.split(line, r" \| ", 6)
    rest = F.split(F.get(parts, F.lit(5)), " » ", 2)
    return [*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(FEED)), F.get(rest, F.lit(0)).alias("session_id"), F.coalesce(F.get(rest, F.lit(1)), F.lit("")).alias("message")]


def feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(*feed_fields(F.col("value")))


def feed_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).where("trim(value) <> ''").select(*feed_fields(F.col("value")))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Sources with differing columns put together; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """What ``read`` gives, or an empty table where its path cannot be read (missing folder, file that is gone)."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def inbox(files: DataFrame, most: int = 500, *, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Handoff files with their time from the name and a preview, newest first; one page of them with ``limit``."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("name"), file_timestamp(name).alias("created"), F.substring("content", 1, most).alias("preview")).orderBy(F.desc("name"))
    return rows if limit is None else rows.offset(max(0, offset)).limit(limit)


#: Hosts whose repositories a vault nests by owner and name, and the folder that marks one.
HOSTS, MARK = ("github.com", "gitlab.com", "bitbucket.org"), "\u03c8"


def project_folders(vault: str) -> list[str]:
    """Glob patterns of the project folders below a vault, for a reader's path."""
    return [f"{vault.rstrip('/')}/{host}/*/*/{MARK}" for host in HOSTS]


def project_of_path(path: Column) -> Column:
    """host/owner/name of a path in a vault: project first, or nested below a category; else null."""
    host = "(" + "|".join(h.replace(".", r"\.") for h in HOSTS) + ")"
    first = rf"^{host}/([^/]+/[^/]+)/{MARK}/"
    nested = rf"^{MARK}/(?:memory/(?:learnings|retrospectives)|inbox/handoff)/{host}/([^/]+/[^/]+)/"
    made = lambda p: F.when(path.rlike(p), F.concat(F.regexp_extract(path, p, 1), F.lit("/"), F.regexp_extract(path, p, 2)))
    return F.lower(F.coalesce(made(first), made(nested)))


def classified(files: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with their type by path, of one type if given, and the number of files of each type."""
    from siltstone.functions.text import doc_kind

    typed = files.withColumn("type", doc_kind(F.col("path")))
    return (typed if kind is None else typed.where(F.col("type") == kind)), typed.groupBy("type").agg(F.count("*").alias("n"))


def change_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(added, modified, deleted)`` of a version control's short status lines: A or ?? is added, else D deleted, else M or R modified."""
    code = F.substring(line, 1, 2)
    kind = F.when(code.contains("A") | (code == "??"), "added").when(code.contains("D"), "deleted").when(code.contains("M") | code.contains("R"), "modified")
    kinds = lines.where(F.trim(line) != "").select(kind.alias("kind"))
    return kinds.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "deleted")))


def of_day(files: DataFrame, day: str) -> DataFrame:
    """Files with a day in their name."""
    return files.where(F.contains(F.element_at(F.split("path", "/"), -1), F.lit(day)))


def with_content(wanted: DataFrame, *places: tuple[str, DataFrame]) -> DataFrame:
    """``(id, source_file, content, source)``: every wanted row's text from the first place that has it; null where none has.

    ``wanted(id, source_file)``; a place is a name and a frame ``(source_file, content)`` or, as the last resort, ``(id, content)``.  Paths
    that leave the root ('..' or absolute) are found nowhere but by id.
    """
    out = wanted.select("id", "source_file", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("source"))
    inside = ~F.coalesce(F.col("source_file").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(True))
    for name, frame in places:
        key = "source_file" if "source_file" in frame.columns else "id"
        own = frame.groupBy(key).agg(F.min("content").alias("__content"))
        found = F.when(inside if key == "source_file" else F.lit(True), F.col("__content"))
        out = out.join(own, key, "left").select(
            "id", "source_file", F.coalesce("content", found).alias("content"), F.coalesce("source", F.when(found.isNotNull(), F.lit(name))).alias("source")
        )
    return out


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
