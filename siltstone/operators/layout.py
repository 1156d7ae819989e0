"""Two- and three-dimensional maps of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import fnv_unit

GOLDEN = (1 + 5**0.5) / 2


def sunflower(files: DataFrame, groups: DataFrame) -> DataFrame:
    """``(file, grp, x, y)``: groups on a sunflower spiral in their order, files scattered around by a hash.

    ``groups(grp, ord, total)`` numbers the groups from 0; it is small and broadcast.
    """
    i, n = F.col("ord").cast("double"), F.col("total").cast("double")
    angle, radius = i * GOLDEN * 2 * np.pi, F.sqrt((i + 0.5) / n) * 0.75
    dx, dy = (fnv_unit(F.col("file")) - 0.5) * 0.2, (fnv_unit(F.concat("file", F.lit("_y"))) - 0.5) * 0.2
    return files.join(F.broadcast(groups), "grp").select("file", "grp", (radius * F.cos(angle) + dx).alias("x"), (radius * F.sin(angle) + dy).alias("y"))


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of every key; combined map-side, so hot keys are harmless."""
    each = vectors.select(key, F.posexplode(vector).alias("at", "value"))
    means = each.groupBy(key, "at").agg(F.avg(F.col("value").cast("double")).alias("m"))
    sorted_ = F.array_sort(F.collect_list(F.struct("at", "m")))
    return means.groupBy(key).agg(F.transform(sorted_, lambda s: s["m"]).alias(vector))


def principal_axes(vectors: DataFrame, vector: str, k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first ``k`` axes and their variances, from one pass of partial d x d sums.

    Each task sends its count, sum and the rows of its Gram matrix; rows of the same place are added in tasks of their own, so that
    d + 2 rows of d numbers come to the driver, however many tasks there were.  An axis points the way of its largest component.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        if n:
            yield pd.DataFrame({"place": [-2, -1, *range(len(gram))], "part": [np.array([float(n)]), total, *gram]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": pdf["place"].iloc[:1], "part": [np.sum(np.stack(pdf["part"].to_numpy()), axis=0)]})

    parts = vectors.select(vector).where(F.col(vector).isNotNull()).mapInPandas(partial, "place int, part array<double>")
    rows = {r["place"]: np.asarray(r["part"]) for r in parts.groupBy("place").applyInPandas(added, "place int, part array<double>").collect()}
    n = rows[-2][0]
    mean = rows[-1] / n
    cov = np.stack([rows[i] for i in range(len(mean))]) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(len(order))])
    return mean, axes, values[order]


def map_3d(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, x, y, z)`` on the first three principal axes, each scaled to -1..1, six decimals."""
    mean, axes, _ = principal_axes(vectors, vector, 3)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = (np.stack(pdf[vector].to_numpy()).astype(np.float64) - mean) @ axes
                yield pd.DataFrame({key: pdf[key], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    kind = vectors.schema[key].dataType.simpleString()
    placed = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(project, f"`{key}` {kind}, x double, y double, z double")
    ends = placed.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = [F.round((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * 2 - 1, 6).alias(c) for c in "xyz"]
    return placed.crossJoin(F.broadcast(ends)).select(key, *scaled)
