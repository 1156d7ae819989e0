"""Most similar vectors by randomly rotated one-bit codes within coarse cells.

Vectors are brought to unit length; equal ones collapse to one.  A coarse quantizer (spherical
k-means on a bounded sample) puts every vector into a cell.  In its cell a vector is the
centroid plus a residual; the residual is rotated by a fixed random orthogonal map and kept
as one sign bit a dimension, packed, with its correction scalars.  A query is rotated once and kept in
four bit planes; popcounts of code and planes give an unbiased estimate of every inner product
with an error bound, and only vectors whose upper bound reaches the query's k-th best lower bound are fetched and compared
exactly.

At scale: every vector is coded where it is read, and the code (an eighth of a byte a dimension) is what moves to meet
the queries; a query moves as half a byte a dimension for each cell it probes.  Whole vectors move once to find equal ones, and
again only for what passes the bounds.  Cells with more than ``block`` vectors or queries are split into blocks that meet
pairwise, so no task holds more than two blocks, whatever share of the rows a cell has.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import stored

#: Standard errors of an estimate that the bound allows for, and bits of a query's component.
EPSILON = 2.5
PLANES = 4


def padded(d: int) -> int:
    """The power of two, 64 at least, to which vectors of ``d`` dimensions are filled with zeros."""
    return max(64, 1 << (d - 1).bit_length())


def rotated(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows under a random orthogonal map, the same everywhere: three rounds of random signs and a Walsh-Hadamard transform.

    d * log(d) steps a row and nothing to keep, where a matrix would take d * d of both.
    """
    n, d = x.shape
    width = padded(d)
    out = np.zeros((n, width), np.float32)
    out[:, :d] = x
    signs = np.random.default_rng(seed).integers(0, 2, (3, width)).astype(np.float32) * 2 - 1
    for round_ in range(3):
        out *= signs[round_]
        half = 1
        while half < width:
            pair = out.reshape(n, -1, 2, half)
            a, b = pair[:, :, 0, :].copy(), pair[:, :, 1, :]
            pair[:, :, 0, :] += b
            pair[:, :, 1, :] = a - b
            half *= 2
        out *= np.float32(width**-0.5)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows brought to length one, in double precision."""
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def train_cells(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Unit centroids of ``cells`` cells by spherical k-means."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    x = sample.astype(np.float32)
    centre = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1)
        empty = length < 1e-9
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centre = total / np.linalg.norm(total, axis=1, keepdims=True)
    return centre


def codes_of(vectors: np.ndarray, centres: np.ndarray) -> pd.DataFrame:
    """One-bit codes of unit vectors around their cells' centroids (one row each), with correction scalars.

    ``code`` has the packed signs of the rotated residual and ``ones`` their number.  With s the signs, the inner product
    of a query q and the vector is about <q, c> + factor * (<Rq, s> - offset) - half, and ``spread`` times |q - c| its error.
    """
    x = vectors.astype(np.float32)
    rest, turned_centre = x - centres, rotated(centres)
    length = np.linalg.norm(rest, axis=1)
    turned = rotated(rest) / np.maximum(length, 1e-12)[:, None]
    width = turned.shape[1]
    bits = turned > 0
    align = np.maximum(np.abs(turned).sum(1) / np.float32(width**0.5), 1e-6)  # code times residual
    packed = np.packbits(bits, axis=1)
    return pd.DataFrame(
        {
            "code": [row.tobytes() for row in packed], "ones": bits.sum(1).astype(np.int32),
            "factor": length / align / np.float32(width**0.5), "offset": np.where(bits, turned_centre, -turned_centre).sum(1), "half": length**2 / 2,
            "spread": EPSILON * length * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.float32((width - 1) ** 0.5),
        }
    ).astype({c: np.float32 for c in ("factor", "offset", "half", "spread")})


def planes_of(queries: np.ndarray) -> pd.DataFrame:
    """Unit queries, rotated and kept in ``PLANES`` bit planes, with the scalars that give the components back."""
    turned = rotated(queries.astype(np.float32))
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits((level >> j) & 1, axis=1) for j in range(PLANES)], axis=1)
    total = low * turned.shape[1] + step * level.sum(1, dtype=np.int64)
    return pd.DataFrame({"planes": [row.tobytes() for row in planes], "low": low, "step": step, "total": total}).astype({c: np.float32 for c in ("low", "step", "total")})


def bounds(codes: pd.DataFrame, asking: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors of one cell, and the error bound of each.

    ``asking`` has the planes and scalars of its queries and ``near``, their inner products with the cell's centroid.
    """
    bits = np.frombuffer(b"".join(codes["code"]), np.uint64).reshape(len(codes), -1)
    planes = np.frombuffer(b"".join(asking["planes"]), np.uint64).reshape(len(asking), PLANES, -1)
    counts = np.zeros((len(asking), len(codes)), np.int32)
    for word in range(bits.shape[1]):
        for j in range(PLANES):
            counts += np.bitwise_count(planes[:, j, word][:, None] & bits[None, :, word]).astype(np.int32) << j
    column = lambda df, c: df[c].to_numpy(np.float32)
    step, low, near = (column(asking, c)[:, None] for c in ("step", "low", "near"))
    signed = 2 * (low * column(codes, "ones")[None, :] + step * counts) - column(asking, "total")[:, None]
    factor = column(codes, "factor")[None, :]
    middle = near + factor * (signed - column(codes, "offset")[None, :]) - column(codes, "half")[None, :]
    gap = np.sqrt(np.maximum(2 - 2 * near, 0))
    rounding = EPSILON * step * np.float32((bits.shape[1] * 64 / 12) ** 0.5)
    return middle, gap * column(codes, "spread")[None, :] + rounding * factor + np.float32(1e-5)


def candidates(codes: pd.DataFrame, asking: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """``(class_id, near, middle, error)``: what may be among a query's k best of at least ``least`` in this cell, the query itself left out."""
    parts = []
    ids, own = codes["class_id"].to_numpy(), asking["class_id"].to_numpy()
    rows = max(1, (1 << 18) // len(codes))
    for lo in range(0, len(asking), rows):
        middle, error = bounds(codes, asking.iloc[lo : lo + rows])
        middle[own[lo : lo + rows][:, None] == ids[None, :]] = -4
        floor = np.full(len(middle), least)
        if len(ids) > k:
            floor = np.maximum(floor, -np.partition(-(middle - error), k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero((middle + error >= floor[:, None]) & (middle > -4))
        parts.append(pd.DataFrame({"class_id": own[lo + r], "near": ids[c], "middle": middle[r, c], "error": error[r, c]}))
    return pd.concat(parts, ignore_index=True)


def nearest_cells(centre: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest cells of each row."""
    n = min(n, len(centre))
    out = np.empty((len(x), n), np.int32)
    for i in range(0, len(x), 4096):
        near = x[i : i + 4096].astype(np.float32) @ centre.T
        out[i : i + 4096] = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centre) else np.arange(n)
    return out


def probes_needed(asked: DataFrame, homes: DataFrame, centres: dict[str, np.ndarray], k: int, least: float, recall: float, sample: int) -> dict[str, int]:
    """Nearest cells a query of each model has to visit to meet the share ``recall`` of its true neighbours.

    Measured: some ``sample`` of the asked vectors are held against every vector in ``homes``, in one pass,
    and the places of their ``k`` nearest's cells are looked up.  A vector is not counted as its own neighbour.
    """
    drawn: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for model in sorted(centres):
        own = asked.where(F.col("model") == model).select("class_id", "vector").orderBy(F.xxhash64(F.lit(9), "class_id"), "class_id").limit(sample).toPandas()
        if len(own):
            drawn[model] = own["class_id"].to_numpy(), unit(np.stack(own["vector"].to_numpy()))
    shipped = homes.sparkSession.sparkContext.broadcast(drawn)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            models = pdf["model"].to_numpy(object)
            for model in sorted(set(models) & set(shipped.value)):
                part = pdf[models == model]
                ids, cells, x = part["class_id"].to_numpy(), part["cell"].to_numpy(), unit(np.stack(part["vector"].to_numpy())).astype(np.float32)
                for lo in range(0, len(x), 2048):
                    score = shipped.value[model][1].astype(np.float32) @ x[lo : lo + 2048].T
                    row, col = np.nonzero(score >= least)
                    if len(row) > len(score) * (k + 1):
                        top = np.argpartition(-score, k, axis=1)[:, : k + 1]
                        row, col = np.repeat(np.arange(len(top)), k + 1), top.ravel()
                    yield pd.DataFrame({"model": model, "query": row, "near": ids[lo + col], "cell": cells[lo + col], "score": score[row, col]})

    best = Window.partitionBy("model", "query").orderBy(F.desc("score"), "near")
    found = homes.mapInPandas(nearest, "model string, query int, near long, cell int, score double").where(F.col("score") >= least)
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).toPandas()
    needed = {}
    for model, part in found.groupby("model"):
        ids, x = drawn[model]
        part = part[ids[part["query"].to_numpy()] != part["near"].to_numpy()]
        if len(part):
            near = x.astype(np.float32) @ centres[model].T
            query = part["query"].to_numpy()
            place = np.sort((near[query] >= near[query, part["cell"].to_numpy()][:, None]).sum(1))
            needed[model] = int(place[ceil(recall * len(place)) - 1])
    return needed


def usable_vectors(df: DataFrame, model: Column, id_: Column, vector: Column, *, distinct: bool = True) -> DataFrame:
    """``(model, id, vector)`` of the vectors that can be compared, each row once (with ``distinct``).

    Null, all-zero and non-finite vectors are left out, as are those not of their model's most
    frequent length (the shorter of two equally frequent ones) and rows without id or model.
    """
    rows = df.select(model.alias("model"), id_.alias("id"), vector.cast("array<float>").alias("vector")).where(
        F.col("id").isNotNull() & F.col("model").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = df.select(model.alias("model"), F.size(vector).alias("d")).where("d > 0 and model is not null").groupBy("model", "d").agg(F.count("*").alias("n"))
    usual = lengths.groupBy("model").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"))
    kept = rows.join(F.broadcast(usual), "model").where(F.size("vector") == F.col("d")).select("model", "id", "vector")
    return kept.distinct() if distinct else kept


def most_similar(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    *,
    k: int = 10,
    min_score: float = -1.0,
    probes: int = 12,
    recall: float | None = None,
    recall_sample: int = 300,
    sample: int = 20_000,
    sample_bytes: int = 256_000_000,
    block: int = 8192,
) -> DataFrame:
    """``(model, id, neighbour, score, rank)``: the k most similar other ids of every query.

    ``vectors(model, id, vector)`` as :func:`usable_vectors` gives them, repeated rows allowed; ``queries(model, id)`` names
    the ids to ask for, all by default.  score is the cosine, computed exactly for everything returned; at equal
    scores the smaller id comes first.  Neighbours below ``min_score`` are left out.  The search is
    approximate in that only the ``probes`` nearest cells are looked at (and by the error bound, which
    holds but for about one in a hundred).  A model has 4 * sqrt(n) cells of its n distinct vectors, fitted on a sample of
    those: ``sample``, or twice the cells if that is more, but at most ``sample_bytes`` of them, which also bounds the broadcast centroids
    (at 1,024 dimensions that is met at some 240 million vectors; beyond, cells grow).  All vectors are indexed.
    With ``recall`` every model's probes are raised to what :func:`probes_needed` measures for that share on ``recall_sample`` queries.
    An id with several vectors of a model is asked for and found by each of them, at its best score.
    """
    spark = vectors.sparkSession
    classed = vectors.select("model", "id", "vector", F.xxhash64("model", "vector").alias("class_id"))
    members = stored(classed.select("model", "id", "class_id").distinct(), "p6-members")
    index = stored(classed.groupBy("class_id").agg(F.first("model").alias("model"), F.first("vector").alias("vector")), "p6-classes")
    asked = members if queries is None else members.join(queries.select("model", "id").distinct(), ["model", "id"], "left_semi")
    asked_classes = index if queries is None else index.join(asked.select("class_id").distinct(), "class_id", "left_semi")
    # what a class of equal vectors can contribute to anyone's k best: its k + 1 smallest ids
    by_id = Window.partitionBy("class_id").orderBy("id")
    heads = members.select("class_id", "id").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).groupBy("class_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    centres: dict[str, np.ndarray] = {}
    for row in sorted(index.groupBy("model").agg(F.count("*").alias("n"), F.first(F.size("vector")).alias("d")).collect()):
        model, n = row["model"], row["n"]
        most = max(1, sample_bytes // (4 * row["d"]))
        cells = min(most, ceil(4 * n**0.5))
        wanted = min(most, max(sample, 2 * cells))
        draw = F.pmod(F.xxhash64(F.lit(5), "class_id"), F.lit(1_000_000)) < int(min(1.0, wanted / n) * 1_000_000) + 1
        drawn = index.where((F.col("model") == model) & draw).select("vector").limit(2 * wanted).toPandas()
        if drawn.empty:  # few vectors, none drawn
            drawn = index.where(F.col("model") == model).select("vector").orderBy("class_id").limit(1).toPandas()
        centres[model] = train_cells(unit(np.stack(drawn["vector"].to_numpy())), cells)
    shipped = spark.sparkContext.broadcast(centres)  # plain arrays: a broadcast is not pickled by value

    def by_model(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame, np.ndarray]]:
        for pdf in batches:
            models = pdf["model"].to_numpy(object)
            for model in sorted(set(models)):
                part = pdf[models == model]
                for lo in range(0, len(part), 4096):
                    piece = part.iloc[lo : lo + 4096].reset_index(drop=True)
                    yield model, piece, unit(np.stack(piece["vector"].to_numpy()))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, part, x in by_model(batches):
            cell = nearest_cells(shipped.value[model], x, 1)[:, 0]
            yield pd.concat([part[["class_id", "model", "vector"]].assign(cell=cell), codes_of(x, shipped.value[model][cell])], axis=1)

    scalars = "ones int, factor float, offset float, half float, spread float"
    homes = stored(index.mapInPandas(coded, f"class_id long, model string, vector array<float>, cell int, code binary, {scalars}"), "p6-index")
    probes_of = dict.fromkeys(centres, probes)
    if recall is not None:
        for model, needed in probes_needed(asked_classes, homes, centres, k, min_score, recall, recall_sample).items():
            probes_of[model] = max(probes, needed)

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, part, x in by_model(batches):
            centre = shipped.value[model]
            cells = nearest_cells(centre, x, probes_of[model])
            row = np.repeat(np.arange(len(part)), cells.shape[1])
            flat = cells.ravel()
            ready = planes_of(x)
            for lo in range(0, len(row), 65536):
                r, c = row[lo : lo + 65536], flat[lo : lo + 65536]
                near = np.einsum("ij,ij->i", x[r].astype(np.float32), centre[c])
                yield pd.concat([part[["class_id", "model"]].iloc[r].reset_index(drop=True).assign(cell=c, near=near), ready.iloc[r].reset_index(drop=True)], axis=1)

    trips = stored(asked_classes.mapInPandas(probing, "class_id long, model string, cell int, near float, planes binary, low float, step float, total float"), "p6-trips")
    # one row a model and cell: how many blocks its vectors and the queries that probe it make
    load = homes.groupBy("model", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("v_blocks"))
    asks = trips.groupBy("model", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    load = load.join(asks, ["model", "cell"])
    salt = F.xxhash64(F.lit(3), "class_id")
    left = homes.drop("vector").join(F.broadcast(load), ["model", "cell"]).withColumn("v", F.pmod(salt, F.col("v_blocks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    right = trips.join(F.broadcast(load), ["model", "cell"]).withColumn("q", F.pmod(salt, F.col("q_blocks")).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
    keys = ["model", "cell", "v", "q"]

    def meet(codes: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(asking):
            return pd.DataFrame({"class_id": [], "near": [], "middle": [], "error": []})
        return candidates(codes, asking, k, min_score)

    left, right = left.drop("v_blocks", "q_blocks"), right.drop("v_blocks", "q_blocks")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "class_id long, near long, middle float, error float")
    sure = Window.partitionBy("class_id").orderBy(F.desc(F.col("middle") - F.col("error"))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    floor = F.nth_value(F.col("middle") - F.col("error"), k).over(sure)
    likely = stored(met.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("middle") + F.col("error") >= F.col("floor"))).select("class_id", "near"), "p6-likely")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            models = pdf["model"].to_numpy(object)
            for model in sorted(set(models)):
                part = pdf[models == model]
                score = np.einsum("ij,ij->i", unit(np.stack(part["q"].to_numpy())), unit(np.stack(part["x"].to_numpy())))
                yield part[["class_id", "near"]].assign(score=score)[score >= min_score]

    vector_of = homes.select("class_id", "model", "vector")
    compared = (
        likely.join(vector_of.select(F.col("class_id").alias("near"), F.col("vector").alias("x")), "near")
        .join(vector_of.select("class_id", "model", F.col("vector").alias("q")), "class_id")
        .mapInPandas(exact, "class_id long, near long, score double")
    )
    own = asked_classes.select("class_id", F.col("class_id").alias("near"), F.lit(1.0).alias("score"))  # the other ids of the same vector
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "near")
    near = compared.unionByName(own).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).select("class_id", "near", "score")
    ranked = Window.partitionBy("model", "id").orderBy(F.desc("score"), "neighbour")
    return (
        near.join(heads.withColumnRenamed("class_id", "near"), "near")
        .join(asked.select("class_id", "model", "id"), "class_id")
        .select("model", "id", "score", F.explode("ids").alias("neighbour"))
        .where("id <> neighbour")
        .groupBy("model", "id", "neighbour").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("model", "id", "neighbour", "score", "rank")
    )
