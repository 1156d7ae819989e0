"""Vector search, fusion of ranked lists, reranking and agreement of models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import stored


# vector search

def matrix_of(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that hold ``d`` finite numbers, and these rows as a matrix, straight from the Arrow buffer."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), d), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.filter(right)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    finite = np.isfinite(flat).all(axis=1)
    return at[finite], flat[finite]


def nearest(vectors: DataFrame, id_col: str, vector: str, query: list[float], k: int, where: Column | None = None, exclude=None) -> DataFrame:
    """``(id, distance)`` of the k nearest unit vectors, distance = 1 - inner product.

    The filter comes before the cut, so k rows come back whenever k match.  One scan with a matrix product a batch, of which only the
    best k (and their ties) go on to a bounded top-k merge.  Any number of dimensions; vectors that are null, of another length or not finite are left out.
    """
    rows = vectors if where is None else vectors.where(where)
    if exclude is not None:
        rows = rows.where(F.col(id_col) != F.lit(exclude))
    q = np.asarray(query, np.float64)
    kind = vectors.schema[id_col].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix_of(batch.column(1), len(q))
            distance = 1.0 - x @ q
            if len(at) > k:
                keep = distance <= np.partition(distance, k - 1)[k - 1]
                at, distance = at[keep], distance[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(distance)], names=["id", "distance"])

    found = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(best, f"id {kind}, distance double")
    return found.orderBy("distance", "id").limit(k)


def nearest_each(vectors: DataFrame, model_col: str, id_col: str, vector: str, queries: dict[str, list[float]], k: int, exclude=None) -> DataFrame:
    """``(model, id, score, rank)``: the k nearest of every model to its own query vector, by cosine, in one scan for all models.

    Models without a query vector have no rows.  An id with several vectors of a model counts at its best; vectors that are null, zero, of
    another length than the query's or not finite are left out.
    """
    rows = vectors.where(F.col(model_col).isin(list(queries)))
    if exclude is not None:
        rows = rows.where(F.col(id_col) != F.lit(exclude))
    unit = {m: np.asarray(q, np.float64) / np.linalg.norm(q) for m, q in queries.items()}
    kind = vectors.schema[id_col].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.asarray(batch.column(0).to_pylist(), object)
            for model, q in unit.items():
                mine = np.flatnonzero(models == model)
                at, x = matrix_of(batch.column(2).take(pa.array(mine)), len(q))
                length = np.linalg.norm(x, axis=1)
                score = x @ q / np.where(length > 0, length, np.nan)
                good = np.flatnonzero(score == score)
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(good), pa.string()), batch.column(1).take(pa.array(mine[at[good]])), pa.array(score[good])], names=["model", "id", "score"])

    each = rows.select(F.col(model_col).alias("model"), F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(best, f"model string, id {kind}, score double")
    w = Window.partitionBy("model").orderBy(F.desc("score"), "id")
    return each.groupBy("model", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def settled(ranked: DataFrame, asked: list[str]) -> DataFrame:
    """``(model, results, error)``: how each model asked for did; one without any result says so, and leaves the others alone."""
    models = ranked.sparkSession.createDataFrame([(m,) for m in asked], "model string")
    counts = ranked.groupBy("model").agg(F.count("*").alias("results"))
    return models.join(counts, "model", "left").select("model", F.coalesce("results", F.lit(0)).alias("results"), F.when(F.col("results").isNull(), "no results").alias("error"))


def vector_of(vectors: DataFrame, id_col: str, vector: str, wanted) -> list[float]:
    """The stored vector of an id; an unknown id is an error."""
    row = vectors.where(F.col(id_col) == F.lit(wanted)).select(vector).first()
    if row is None:
        raise KeyError(f"no vector for id {wanted!r}")
    return list(row[0])


def similar_links(vectors: DataFrame, id_col: str, vector: str, asked: DataFrame, *, threshold: float, most: int, block: int = 8192, most_cells: int = 1024) -> DataFrame:
    """``(id, other, score)``: up to ``most`` other vectors of at least ``threshold`` for every asked id, exactly.

    Vectors are unit vectors.  They are dealt to cells around some of them; an asked vector meets a cell only if the cell's radius allows the
    threshold there, by the triangle inequality of angles.  Cells and the vectors asked of them are cut in blocks of ``block`` that meet pairwise in one
    matrix product each, so nothing but ``most_cells`` vectors is ever on the driver, and hot cells are split.  Each block keeps its best ``most`` for a query.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    plain = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null")
    rows = plain(vectors)
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    cells = int(min(most_cells, max(1, n // block)))
    drawn = rows.where(F.size("v") == d).orderBy(F.xxhash64(F.lit(29), "id"), "id").limit(cells).toPandas() if n else None
    centre = np.stack(drawn["v"].to_numpy()).astype(np.float32) if n else np.zeros((1, 1), np.float32)
    shipped = spark.sparkContext.broadcast(centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12))

    def angles(x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x.astype(np.float32) @ shipped.value.T, -1, 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix_of(batch.column(1), d)
            if len(at):
                to = angles(x)
                cell = to.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cell, pa.int32()), pa.array(to[np.arange(len(at)), cell], pa.float32())], names=["id", "v", "cell", "angle"])

    homes = stored(rows.mapInArrow(placed, f"id {kind}, v array<float>, cell int, angle float"), "cells")
    load = homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("v_blocks"))
    radius = {r["cell"]: r["radius"] for r in load.collect()}  # at most most_cells rows
    reach = np.array([radius.get(c, -10.0) for c in range(len(centre))]) + np.arccos(np.clip(threshold, -1, 1)) + 1e-3  # float32 angles

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix_of(batch.column(1), d)
            if len(at):
                row, cell = np.nonzero(angles(x) <= reach)
                to = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(to), batch.column(1).take(to), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

    trips = stored(plain(asked).mapInArrow(probing, f"id {kind}, v array<float>, cell int"), "trips")
    counts = load.join(trips.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks")), "cell")
    salt = F.xxhash64(F.lit(31), "id")
    spread_ = lambda df, own, other: df.join(F.broadcast(counts), "cell").withColumn(own, F.pmod(salt, F.col(f"{own}_blocks")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).select("cell", "v_", "q_", "id", "vec")
    counts = counts.withColumnsRenamed({"v_blocks": "v__blocks", "q_blocks": "q__blocks"})
    left, right = spread_(homes.withColumnRenamed("v", "vec"), "v_", "q_"), spread_(trips.withColumnRenamed("v", "vec"), "q_", "v_")

    def meet(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"id": [], "other": [], "score": []})
        x, ids, names = np.stack(own["vec"].to_numpy()).astype(np.float64), own["id"].to_numpy(), asking["id"].to_numpy()
        parts = []
        for lo in range(0, len(asking), 256):
            q, who = np.stack(asking["vec"].to_numpy()[lo : lo + 256]).astype(np.float64), names[lo : lo + 256]
            score = q @ x.T
            score[who[:, None] == ids[None, :]] = -np.inf
            r, c = np.nonzero(score >= threshold)
            s = score[r, c]
            order = np.lexsort((ids[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < most
            parts.append(pd.DataFrame({"id": who[r[keep]], "other": ids[c[keep]], "score": s[keep]}))
        return pd.concat(parts, ignore_index=True)

    keys = ["cell", "v_", "q_"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"id {kind}, other {kind}, score double")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return met.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most).drop("at")


# fusion

def fuse_weighted(text: DataFrame, vector: DataFrame, wt: float = 0.5, wv: float = 0.5) -> DataFrame:
    """Tool profile: weighted scores, times 1.1 for a hit of both lists.  Both have (id, score)."""
    j = text.withColumnRenamed("score", "t").join(vector.withColumnRenamed("score", "v"), "id", "full_outer")
    both = F.col("t").isNotNull() & F.col("v").isNotNull()
    score = F.when(both, (F.col("t") * wt + F.col("v") * wv) * 1.1).otherwise(F.coalesce(F.col("t") * wt, F.col("v") * wv))
    return j.select("id", score.alias("score"), _source(both))


def fuse_best(text: DataFrame, vector: DataFrame, bonus: float = 0.1) -> DataFrame:
    """HTTP profile: the better score, plus a bonus for a hit of both lists, at most 1."""
    j = text.withColumnRenamed("score", "t").join(vector.withColumnRenamed("score", "v"), "id", "full_outer")
    both = F.col("t").isNotNull() & F.col("v").isNotNull()
    score = F.when(both, F.least(F.lit(1.0), F.greatest("t", "v") + bonus)).otherwise(F.coalesce("t", "v"))
    return j.select("id", score.alias("score"), _source(both))


def _source(both: Column) -> Column:
    return F.when(both, "hybrid").when(F.col("t").isNotNull(), "fts").otherwise("vector").alias("source")


def merge_models(first: DataFrame, second: DataFrame, boost: float = 0.05) -> DataFrame:
    """Lists of two models: a later, strictly better score replaces the earlier one and is boosted, at most 1."""
    j = first.withColumnRenamed("score", "a").join(second.withColumnRenamed("score", "b"), "id", "full_outer")
    better = F.col("b") > F.col("a")
    score = F.when(better, F.least(F.lit(1.0), F.col("b") + boost)).otherwise(F.coalesce("a", "b"))
    return j.select("id", score.alias("score"), F.when(better, "hybrid").otherwise("vector").alias("source"))


def rerank(ranked: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], head: int = 50) -> DataFrame:
    """The first ``head`` rows in the order of ``scorer``, the rest behind them as it was; nothing is lost.

    ``ranked`` has (id, rank, text); a row that the scorer gives no score stays behind the scored ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["id", "rank"]].assign(better=np.asarray(scorer(pdf), float))

    kind = ranked.schema["id"].dataType.simpleString()
    scored = ranked.where(F.col("rank") <= head).mapInPandas(run, f"id {kind}, rank int, better double").select("id", "better")
    w = Window.orderBy(F.desc_nulls_last(F.when(F.isnan("better"), None).otherwise(F.col("better"))), "rank", "id")
    return ranked.join(scored, "id", "left").withColumn("new_rank", F.row_number().over(w))


# agreement of models; ``ranked`` has (model, id, rank) of one query

def rank_lists(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("model").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w))


def agreement_at(ranked: DataFrame, k: int) -> DataFrame:
    """Share of the models that have a k-th hit which agree with the largest group on it."""
    n = ranked.where(F.col("rank") == k).groupBy("id").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)), 4).alias("agreement"))


def top_jaccard(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Ids in every model's first k over ids in any."""
    top = ranked.where(F.col("rank") <= k)
    models = top.agg(F.countDistinct("model").alias("models"))
    ids = top.groupBy("id").agg(F.countDistinct("model").alias("m"))
    return ids.crossJoin(F.broadcast(models)).agg(F.round(F.coalesce(F.count_if(F.col("m") == F.col("models")) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("jaccard"))


def rank_shift(ranked: DataFrame) -> DataFrame:
    """Mean distance of best and worst rank over ids that at least two lists have."""
    each = ranked.groupBy("id").agg(F.count("*").alias("n"), (F.max("rank") - F.min("rank")).alias("shift")).where("n >= 2")
    return each.agg(F.round(F.coalesce(F.avg("shift"), F.lit(0.0)), 4).alias("avg_shift"))


def shared_ids(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("id").agg(F.countDistinct("model").alias("models")).where("models >= 2")


def retrieval_scores(ranked: DataFrame) -> DataFrame:
    """Queries, recall at 1 and at 5, and the share of queries with a hit of another language than their own among the first 3.

    ``ranked`` has (query, rank, expected boolean, other_language boolean).
    """
    within = lambda k, c: F.max(((F.col("rank") <= k) & F.col(c)).cast("int"))
    each = ranked.groupBy("query").agg(within(1, "expected").alias("one"), within(5, "expected").alias("five"), within(3, "other_language").alias("cross"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("one"), 4).alias("recall_1"), F.round(F.avg("five"), 4).alias("recall_5"), F.round(F.avg("cross"), 4).alias("cross_language_3"))


def recall_at(ranked: DataFrame, k: int) -> DataFrame:
    """Share of queries with an expected hit among their first k; ``ranked`` has (query, rank, expected boolean)."""
    each = ranked.groupBy("query").agg(F.max(((F.col("rank") <= k) & F.col("expected")).cast("int")).alias("hit"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 4).alias("recall"))
