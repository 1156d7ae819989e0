"""One facade over a knowledge base: search, list, learn, supersede and the rest; traces, threads, logs and appointments have operators of their own.

Methods return DataFrames (nothing runs until they are read) or write through the snapshot and
append sinks.  'now' and 'today' are parameters of what depends on them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import dates, scores, text
from siltstone.functions.keys import concept_list
from siltstone.operators import embed, fts, graph, merge, relational as rel, search
from siltstone.sources import sinks
from siltstone.storage import new_folder


class KnowledgeBase:
    """Tables ``docs(id, type, source_file, content, concepts array, created_at, updated_at, indexed_at, superseded_by, project, ...)`` and ``vectors(model_key, id, vector)``."""

    def __init__(self, spark: SparkSession, docs: DataFrame, vectors: DataFrame | None = None, index: fts.Index | None = None):
        self.spark, self.docs, self.vectors, self._index = spark, docs, vectors, index

    @property
    def index(self) -> fts.Index:
        """The stored full-text index over contents and concepts, by stems; built at the first search if none was given."""
        if self._index is None:
            self._index = fts.Index.build(self.docs, "id", ["content", "concepts"], new_folder(self.spark, "fts"), buckets=16, stem=True)
        return self._index

    # reading

    def list(self, kind: str = "all", limit: int = 10, offset: int = 0) -> DataFrame:
        rows = rel.by_type(self.docs, kind)
        return rel.page(rows, [F.desc("indexed_at"), F.asc("id")], limit, offset).select("id", "type", "source_file", text.first_line(F.col("content")).alias("title"), F.substring("content", 1, 500).alias("content"))

    def read(self, doc_id: str) -> DataFrame:
        return self.docs.where(F.col("id") == doc_id)

    def stats(self, now: int) -> DataFrame:
        return self.docs.agg(
            F.count("*").alias("docs"), F.countDistinct("source_file").alias("files"), F.max("indexed_at").alias("last_indexed"), dates.age_hours(now, F.max("indexed_at")).alias("age_hours")
        )

    def concepts(self, limit: int = 50, kind: str = "all") -> DataFrame:
        return rel.top_counts(rel.by_type(self.docs, kind).select(F.explode("concepts").alias("concept")), "concept", limit)

    def reflect(self, seed: int) -> DataFrame:
        return self.docs.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1)

    def graph(self, per_type: int = 310, seed: int = 0) -> DataFrame:
        return graph.concept_edges(rel.sample_per_group(self.docs, "type", "id", per_type, seed), "id", "concepts")

    # search

    def search(self, query: str, *, kind: str = "all", project: str | None = None, limit: int = 5, offset: int = 0, mode: str = "hybrid", profile: str = "tool", model: str | None = None) -> DataFrame:
        """``(id, score, source, type, content, superseded_by)``: keyword, vector or fused hits, best first.

        Words side by side must all be there; AND, OR and NOT in upper case are operators.  A failing or absent vector side leaves the keyword
        side, with a warning.  One model gives 2 * (limit + offset) candidates a side.
        """
        docs = rel.in_scope(rel.by_type(self.docs, kind), project)
        width = 2 * (limit + offset)
        normal = scores.rank_decay if profile == "tool" else scores.rank_reciprocal
        empty = self.spark.createDataFrame([], "id string, score double")
        keyword = empty
        if mode != "vector":
            clean = self.spark.range(1).select(text.sanitize_query(F.lit(query))).first()[0]
            hits = self.index.scored(clean)
            hits = hits if kind == "all" and project is None else hits.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
            keyword = fts.top_k(hits, width).select(F.col("doc_id").alias("id"), normal(F.col("score")).alias("score"))
        vector = empty
        if self.vectors is not None and mode != "fts":
            try:
                vector = self._near(query, docs, width, profile, model).select("id", scores.distance_similarity(F.col("distance"), profile).alias("score"))
            except Exception as error:  # whatever the vector side's trouble, keywords still answer
                warnings.warn(f"vector search left out: {error}", RuntimeWarning, stacklevel=2)
                vector = empty
        fused = (search.fuse_weighted if profile == "tool" else search.fuse_best)(keyword, vector)
        hits = fused.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
        return self.docs.join(F.broadcast(hits), "id").select("id", "score", "source", "type", F.substring("content", 1, 500).alias("content"), "superseded_by").orderBy(F.desc("score"), "id")

    def _near(self, query: str, docs: DataFrame, width: int, profile: str, model: str | None) -> DataFrame:
        model = embed.model_or_default(model)
        asked = embed.hashing_embedder(embed.REGISTRY[model])([query])[0]
        own = self.vectors.where(F.col("model_key") == model)
        own = own if profile == "tool" else own.join(docs.select("id"), "id", "left_semi")
        near = search.nearest(own, "id", "vector", list(asked), width)
        return self.spark.createDataFrame(near.collect(), near.schema)  # ``width`` rows; here, so that a failure shows here

    def total(self, query: str, shown: int) -> int:
        """How many records match, at least as many as are shown."""
        clean = self.spark.range(1).select(text.sanitize_query(F.lit(query))).first()[0]
        return max(self.index.scored(clean).count(), shown)

    def similar(self, doc_id: str, limit: int = 5, model: str | None = None) -> DataFrame:
        own = self.vectors.where(F.col("model_key") == embed.model_or_default(model))
        near = search.nearest(own, "id", "vector", search.vector_of(own, "id", "vector", doc_id), min(50, max(1, limit)), exclude=doc_id)
        return near.select("id", scores.distance_similarity(F.col("distance"), "similar").alias("similarity")).join(self.docs, "id", "left").orderBy(F.desc("similarity"), "id")

    # writing: each returns the new table, which write() stores as the next snapshot

    def learned(self, pattern: str, now: int, *, concepts: str = "", project: str | None = None, source: str = "learn") -> DataFrame:
        """The table with a new learning; one that exists already is an error."""
        day = self.spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(now)), "yyyy-MM-dd"), text.slug(F.lit(pattern)), concept_list(F.lit(concepts)), text.normalized_project(F.lit(project))).first()
        row = self.spark.createDataFrame(
            [(f"learning_{day[0]}_{day[1] or f'pattern-{now}'}", "learning", f"memory/learnings/{day[0]}_{day[1]}.md", pattern, list(day[2]), now, now, now, day[3], source)],
            "id string, type string, source_file string, content string, concepts array<string>, created_at long, updated_at long, indexed_at long, project string, created_by string",
        )
        if self.docs.join(row.select("id"), "id", "left_semi").limit(1).count():
            raise FileExistsError(f"the learning {row.first()['id']} exists")
        return self.docs.unionByName(row, allowMissingColumns=True)

    def superseded(self, old: str, new: str, now: int, reason: str | None = None) -> DataFrame:
        """The table with ``old`` marked as replaced; both ids must exist."""
        if self.docs.where(F.col("id").isin(old, new)).select("id").distinct().count() != len({old, new}):
            raise KeyError("both records must exist")
        hit = F.col("id") == old
        changed = {"superseded_by": F.lit(new), "superseded_at": F.lit(now), "superseded_reason": F.lit(reason)}
        return self.docs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items() if c in self.docs.columns})

    def reindexed(self, new: DataFrame) -> DataFrame:
        """The table after an index run: known records keep what only people set."""
        return merge.upsert(self.docs, new, "id", keep=[c for c in ("created_at", "created_by", "origin", "superseded_by", "superseded_at", "superseded_reason") if c in self.docs.columns])

    def embedded(self, model: str | None = None, embedder: embed.Embedder | None = None) -> DataFrame:
        return embed.embedded(self.docs, "id", "content", embed.model_or_default(model), embedder)

    @staticmethod
    def write(df: DataFrame, root: str) -> str:
        return sinks.write_snapshot(df, root)
