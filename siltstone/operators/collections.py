"""Vector collections as stored tables, behind one interface that other stores can take the place of."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import embed, search
from siltstone.sources import sinks


class VectorIndex(Protocol):
    """What the engine asks of a store of vectors ``(model_key, id, vector)``."""

    def ensure(self) -> None: ...
    def add(self, rows: DataFrame) -> None: ...
    def query(self, vector: list[float], k: int, where: Column | None = None) -> DataFrame: ...
    def query_by_id(self, id_: str, k: int) -> DataFrame: ...
    def stats(self) -> DataFrame: ...
    def delete(self) -> None: ...


class Collection:
    """One model's vectors as versioned snapshots below ``root``; rows are replaced by id, never appended twice."""

    SCHEMA = "model_key string, id string, vector array<float>"

    def __init__(self, spark: SparkSession, root: str, model: str):
        self.spark, self.root, self.model = spark, f"{root.rstrip('/')}/{model}", model

    def exists(self) -> bool:
        fs, top, _ = sinks._fs(self.spark, self.root)
        return fs.exists(top)

    def ensure(self) -> None:
        if not self.exists():
            sinks.write_snapshot(self.spark.createDataFrame([], self.SCHEMA), self.root)

    def rows(self) -> DataFrame:
        return sinks.read_snapshot(self.spark, self.root)

    def add(self, rows: DataFrame) -> None:
        self.ensure()
        sinks.write_snapshot(embed.upserted(self.rows(), rows.select("model_key", "id", "vector")), self.root)

    def query(self, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
        return search.nearest(self.rows(), "id", "vector", vector, k, where)

    def query_by_id(self, id_: str, k: int) -> DataFrame:
        own = self.rows()
        return search.nearest(own, "id", "vector", search.vector_of(own, "id", "vector", id_), k, exclude=id_)

    def stats(self) -> DataFrame:
        """One row: the model, whether there is a collection, how many vectors and of how many dimensions."""
        if not self.exists():
            return self.spark.createDataFrame([(self.model, False, 0, None)], "model_key string, enabled boolean, vectors long, dimensions int")
        return self.rows().agg(F.lit(self.model).alias("model_key"), F.lit(True).alias("enabled"), F.count("*").alias("vectors"), F.max(F.size("vector")).alias("dimensions"))

    def delete(self) -> None:
        fs, top, _ = sinks._fs(self.spark, self.root)
        fs.delete(top, True)


def health(collections: list[Collection]) -> DataFrame:
    """'ok' if all collections are there, 'degraded' if some are, else 'down'."""
    there = [c.exists() for c in collections]
    status = "ok" if all(there) and there else "degraded" if any(there) else "down"
    return collections[0].spark.createDataFrame([(status, sum(there), len(there))], "status string, available int, total int")
