"""Writers: versioned snapshots with an atomic pointer, appends, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import csv_field


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def write_snapshot(df: DataFrame, root: str, *, partition_by: list[str] | None = None, keep: int = 10) -> str:
    """Writes a new version below ``root`` and then moves the pointer: readers see the old or the new one, never a part.

    Versions past the ``keep`` newest are removed.  One writer at a time.
    """
    spark = df.sparkSession
    fs, top, jvm = _fs(spark, root)
    number = 1 + max([int(s.getPath().getName()[1:9]) for s in fs.listStatus(top) if s.getPath().getName().startswith("v")] if fs.exists(top) else [0], default=0)
    name = f"v{number:08d}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}")
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/current.txt")
    staged = jvm.org.apache.hadoop.fs.Path(f"{root}/_staged.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(name, "ascii"))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    full = fs.makeQualified(staged)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(full, fs.makeQualified(pointer), how)
    for old in sorted(s.getPath().getName() for s in fs.listStatus(top) if s.getPath().getName().startswith("v"))[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    name = spark.read.text(f"{root}/current.txt").first()[0].strip()
    return spark.read.parquet(f"{root}/{name}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def csv_lines(df: DataFrame, cols: list[str]) -> DataFrame:
    """One RFC 4180 line a row."""
    return df.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in cols)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_export(docs: DataFrame, path: str, exported_at: str) -> int:
    """Records as JSON lines below ``path/documents`` and an envelope beside them with the time and their number; returns the number."""
    docs.write.mode("overwrite").json(f"{path}/documents")
    count = docs.sparkSession.read.text(f"{path}/documents").count()
    docs.sparkSession.createDataFrame([(exported_at, count)], "exported_at string, count long").coalesce(1).write.mode("overwrite").json(f"{path}/envelope")
    return count


def append_feed(lines: DataFrame, path: str, line: str = "line") -> None:
    """Appends feed lines as further text files of the folder."""
    lines.select(line).write.mode("append").text(path)


def free_name(taken: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(name, free)``: each wanted file name, with '-2', '-3', ... before its extension where the folder or an earlier wanted row has it.

    ``wanted(name, ord)``.  Numbers follow the largest that is taken, so two names never meet.
    """
    from pyspark.sql import Window

    stem = F.regexp_replace("name", r"\.md$", "")
    parts = taken.select(F.regexp_replace("name", r"\.md$", "").alias("__full")).distinct()
    number = F.regexp_extract("__full", r"-(\d+)$", 1)
    plain = parts.select(F.col("__full").alias("__stem"), F.lit(1).alias("n"))
    counted = parts.where(number != "").select(F.regexp_replace("__full", r"-\d+$", "").alias("__stem"), number.cast("int").alias("n"))
    top = plain.unionByName(counted).groupBy("__stem").agg(F.max("n").alias("top"), F.max(F.col("n") == 1).alias("has"))
    w = Window.partitionBy("name").orderBy("ord")
    at = wanted.withColumn("__stem", stem).join(top, "__stem", "left").withColumn("__at", F.row_number().over(w))
    first = F.coalesce("has", F.lit(False))
    n = F.when(first, F.col("top")).otherwise(F.greatest(F.coalesce("top", F.lit(1)), F.lit(1))) + F.col("__at") - F.when(first, 0).otherwise(1)
    return at.select("name", "ord", F.when(~first & (F.col("__at") == 1), F.col("name")).otherwise(F.concat("__stem", F.lit("-"), n.cast("string"), F.lit(".md"))).alias("free"))


def handoffs(notes: DataFrame, taken: DataFrame, stamp: str) -> DataFrame:
    """``(name, content)`` of handoff files: ``notes(ord, content, slug)``, named by time and slug, or by what the text begins with; blank notes are left out."""
    from siltstone.functions.text import slug as slugged

    good = notes.where(F.coalesce(F.trim("content") != "", F.lit(False)))
    word = F.coalesce(F.nullif("slug", F.lit("")), F.nullif(slugged(F.col("content")), F.lit("")), F.lit("handoff"))
    named = good.select("ord", "content", F.concat(F.lit(stamp + "_"), word, F.lit(".md")).alias("name"))
    return named.join(free_name(taken, named.select("name", "ord")), ["name", "ord"]).select(F.col("free").alias("name"), "content")


def session_summaries(rows: DataFrame) -> DataFrame:
    """Learnings of session summaries: ``rows(session_id, summary, who)``; ids and names in safe characters, empty sessions left out."""
    from siltstone.functions.text import safe_id

    session, who = safe_id(F.col("session_id"), 120), F.nullif(safe_id(F.col("who"), 80), F.lit(""))
    concepts = F.array_compact(F.array(F.lit("session-summary"), F.concat(F.lit("session-"), session), F.concat(F.lit("oracle-"), who)))
    return rows.where(F.coalesce(session != "", F.lit(False))).select(
        F.concat(F.lit("session-summary_"), session).alias("id"), F.lit("learning").alias("type"), F.concat(F.lit("memory/session-summaries/"), session, F.lit(".md")).alias("source_file"),
        F.col("summary").alias("content"), concepts.alias("concepts"), F.lit("session_summary").alias("created_by"),
    )


def changed_files(rendered: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rendered(path, content)`` what differs from the last export's ``state(path, hash)``, and the state after it."""
    hashed = rendered.withColumn("hash", F.sha2("content", 256))
    return hashed.join(state.select("path", "hash"), ["path", "hash"], "left_anti").select("path", "content"), hashed.select("path", "hash")


def write_files(files: DataFrame, root: str) -> int:
    """Writes ``files(path, content)`` below a folder that all executors share, each under a temporary name that is then renamed; returns their number."""
    def write(batches):
        import os

        import pandas as pd

        n = 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                full = os.path.join(root, path)
                if not os.path.abspath(full).startswith(os.path.abspath(root) + os.sep):
                    raise ValueError(f"{path} leaves {root}")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                staged = f"{full}.{os.getpid()}.tmp"
                with open(staged, "w", encoding="utf-8") as out:
                    out.write(content)
                os.replace(staged, full)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def feed_line(*cols: str):
    """A feed line of six columns and a message."""
    head = F.concat_ws(" | ", *cols[:6])
    return F.concat_ws(" » ", head, F.col(cols[6]))
