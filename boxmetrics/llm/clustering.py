"""Exact k-means by Shallot search (Borgelt, 2020).

A vector keeps its nearest centroid, the second nearest it knew, an upper bound of its distance
to the first and a lower bound of its distances to all others. When centroids have moved, the
bounds are moved by as much. While they do not meet, nothing is computed. Otherwise the
distances to both remembered centroids are computed, and the search starts at the closer one:
its neighbours are read in the order of their distance from it, and only as far as a ball
reaches in which a centroid nearer than the second nearest could lie. Each centroid found nearer
shrinks the ball. Bounds are floating-point numbers with a margin; what survives them is
compared by whole squared distances, so the result is that of the plain method.

Each round reads the vectors with their state as stored by the round before, and writes them
anew. What reaches the driver are the starting vectors and sums per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import stored

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
SEED_PREFIX = "2:"
#: Greatest size of a whole component: squared distances of 64 of them still fit a long.
LARGEST = 1 << 27
#: What bounds are kept apart by, as a share of them. Their own errors are far smaller.
MARGIN = 1e-9
#: Vectors whose distances are computed at a time.
BLOCK = 4096

_STATE = "vec_id long, v binary, cluster int, second int, upper double, lower double"


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} / {scale} have no exact distances")
    return scaled.astype(np.int32)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand side by side."""
    apart = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class State:
    cluster: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, rows: int, centroids: int) -> State:
        """Nothing is known yet; the first two centroids are where the search starts."""
        first, other = np.zeros(rows, np.int32), np.full(rows, min(1, centroids - 1), np.int32)
        return cls(first, other, np.full(rows, np.inf), np.zeros(rows))


class Shallot:
    """The search among one set of centroids, for vectors bounded by the set before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids = centroids
        count = len(centroids)
        apart = np.sqrt(np.stack([squared(centroids, one) for one in centroids]).astype(float))
        #: For each centroid, the others by distance from it, and these distances.
        order = np.argsort(apart, axis=1, kind="stable")
        self._neighbours = np.array([row[row != at] for at, row in enumerate(order)]).reshape(count, count - 1)
        self._reach = np.take_along_axis(apart, self._neighbours, axis=1) if count > 1 else np.zeros((1, 0))
        self._half = self._reach[:, 0] / 2 if count > 1 else np.full(1, np.inf)
        moved = np.zeros(count) if before is None else np.sqrt(squared(centroids, before).astype(float))
        self._moved = moved * (1 + MARGIN)
        # The farthest move among the others of each centroid.
        farthest = int(np.argmax(self._moved))
        others = np.delete(self._moved, farthest)
        self._others_moved = np.full(count, self._moved[farthest])
        self._others_moved[farthest] = others.max() if len(others) else 0.0

    def assign(self, vectors: np.ndarray, state: State) -> None:
        """Bring the state of the vectors up to these centroids."""
        state.upper += self._moved[state.cluster]
        state.lower -= self._others_moved[state.cluster]
        for at in range(0, len(vectors), BLOCK):
            part = np.arange(at, min(at + BLOCK, len(vectors)))
            asked = part[self._open(state, part)]
            state.upper[asked] = np.sqrt(squared(vectors[asked], self.centroids[state.cluster[asked]]))
            asked = asked[self._open(state, asked)]
            if len(asked) and len(self.centroids) > 1:
                self._search(vectors, state, asked)

    def _open(self, state: State, rows: np.ndarray) -> np.ndarray:
        """Where another centroid may be as near as the own one."""
        known = np.maximum(state.lower[rows], self._half[state.cluster[rows]])
        return state.upper[rows] * (1 + MARGIN) >= known * (1 - MARGIN)

    def _search(self, vectors: np.ndarray, state: State, rows: np.ndarray) -> None:
        mine = vectors[rows]
        first, second = state.cluster[rows].copy(), state.second[rows].copy()
        near, next_near = squared(mine, self.centroids[first]), squared(mine, self.centroids[second])
        first, near, second, next_near = _ordered(first, near, second, next_near)
        origin, remembered = first.copy(), second.copy()
        centre = np.sqrt(near)
        ball = (centre + np.sqrt(next_near)) * (1 + MARGIN)
        active = np.arange(len(rows))
        for place in range(self._neighbours.shape[1]):
            # Neighbours are sorted: what is out of the ball now stays out of it.
            active = active[self._reach[origin[active], place] <= ball[active]]
            if not len(active):
                break
            other = self._neighbours[origin[active], place]
            fresh = other != remembered[active]
            asked, other = active[fresh], other[fresh]
            found = squared(mine[asked], self.centroids[other])
            nearer = (found < near[asked]) | ((found == near[asked]) & (other < first[asked]))
            middle = ~nearer & ((found < next_near[asked]) | ((found == next_near[asked]) & (other < second[asked])))
            moved = asked[nearer]
            second[moved], next_near[moved] = first[moved], near[moved]
            first[moved], near[moved] = other[nearer], found[nearer]
            second[asked[middle]], next_near[asked[middle]] = other[middle], found[middle]
            changed = asked[nearer | middle]
            ball[changed] = (centre[changed] + np.sqrt(next_near[changed])) * (1 + MARGIN)
        state.cluster[rows], state.second[rows] = first, second
        state.upper[rows], state.lower[rows] = np.sqrt(near), np.sqrt(next_near)


def _ordered(first: np.ndarray, near: np.ndarray, second: np.ndarray, next_near: np.ndarray) -> tuple:
    """The two remembered centroids, the closer one first; of equally close ones the smaller."""
    swap = (next_near < near) | ((next_near == near) & (second < first))
    return (
        np.where(swap, second, first),
        np.where(swap, next_near, near),
        np.where(swap, first, second),
        np.where(swap, near, next_near),
    )


def _vectors(column: pa.Array, components: int) -> np.ndarray:
    content = b"".join(column.to_pylist()) if len(column) else b""
    return np.frombuffer(content, dtype="<i4").reshape(len(column), components)


def _state_batch(ids: pa.Array, packed: pa.Array, state: State) -> pa.RecordBatch:
    return pa.record_batch(
        [ids, packed, pa.array(state.cluster), pa.array(state.second), pa.array(state.upper), pa.array(state.lower)],
        names=["vec_id", "v", "cluster", "second", "upper", "lower"],
    )


def valid(embedding: Column, components: int) -> Column:
    """Whether a vector has the number of components, all of them finite numbers."""

    def finite(x: Column) -> Column:
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))

    return embedding.isNotNull() & (F.size(embedding) == components) & F.forall(embedding, finite)


def whole_vectors(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """`vec_id` and `v`, the whole components as 32-bit integers, of all valid vectors."""

    @F.arrow_udf("binary")
    def packed(given: pa.Array) -> pa.Array:
        values = given.flatten().to_numpy(zero_copy_only=False).reshape(len(given), components)
        return pa.array([row.tobytes() for row in whole(values).astype("<i4")], pa.binary())

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kept = rows.filter(valid(F.col("embedding"), components))
    return kept.select("vec_id", packed(F.col("embedding").cast("array<double>")).alias("v"))


def starting_centroids(vectors: DataFrame, count: int = CENTROIDS) -> list[bytes]:
    """The vectors with the smallest hashes of their ids; of equal ids the smaller vector."""
    named = F.sha2(F.concat(F.lit(SEED_PREFIX), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select("v", named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(count)
    return [bytes(row["v"]) for row in chosen.collect()]


def _sums(state: DataFrame, components: int) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of the vectors of each cluster."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            vectors = _vectors(batch["v"], components).astype(np.int64)
            cluster = batch["cluster"].to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0]) if len(order) else []
            if not len(begins):
                continue
            found = np.add.reduceat(vectors[order], begins)
            sizes = np.diff(np.r_[begins, len(order)])
            for number, size, sums in zip(cluster[order][begins].tolist(), sizes.tolist(), found.tolist()):
                row = [size, *sums]
                totals[number] = [a + b for a, b in zip(totals.get(number, [0] * len(row)), row)]
        yield pa.record_batch(
            [pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    parts = state.select("v", "cluster").mapInArrow(added, "cluster int, sums array<bigint>")
    # One row per centroid and component, whatever the number of tasks.
    totals = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("total"))
    found: dict[int, list[int]] = {}
    for row in totals.orderBy("cluster", "pos").collect():
        found.setdefault(row["cluster"], []).append(row["total"])
    return {number: (sums[0], sums[1:]) for number, sums in found.items()}


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    components = centroids.shape[1]
    known = "cluster" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Shallot(centroids, before)
        for batch in batches:
            vectors = _vectors(batch["v"], components)
            if known:
                columns = [batch[name].to_numpy(zero_copy_only=False).copy() for name in batch.schema.names[2:]]
                state = State(*columns)
            else:
                state = State.unknown(len(vectors), len(centroids))
            search.assign(vectors, state)
            yield _state_batch(batch["vec_id"], batch["v"], state)

    return rows.mapInArrow(assign, _STATE)


def _moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """The floor of the mean of each cluster; centroids without vectors stay."""
    after = centroids.copy()
    for number, (count, totals) in sums.items():
        after[number] = [total // count for total in totals]
    return after


def centroid_clusters(
    embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS
) -> DataFrame:
    """Cluster and distance of every valid vector, with sums of distances and the centroid's digest.

    Vectors that are null, of another length, or with a null or non-finite component are left
    out. Repeated rows count each and each give a row. A row without an id is clustered; it is a
    starting centroid only if there are fewer vectors with an id than centroids. Fewer vectors
    than centroids make as many centroids as there are; equally near ones count in the order
    of their numbers. Components too large for exact distances in a long stop the job. An empty
    table has no clusters. Other columns are ignored.
    """
    vectors = stored(whole_vectors(embeddings, components), "vectors")
    chosen = starting_centroids(vectors, count)
    if not chosen:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    centroids = np.stack([np.frombuffer(one, dtype="<i4") for one in chosen]).astype(np.int64)
    rows, before = vectors, None
    for _ in range(rounds):
        rows = stored(_assigned(rows, centroids, before), "assigned")
        before, centroids = centroids, _moved(centroids, _sums(rows, components))
    return _measured(stored(_assigned(rows, centroids, before), "assigned"), centroids)


_RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
)


def _measured(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    components = centroids.shape[1]

    @F.arrow_udf("bigint")
    def distance(packed: pa.Array, cluster: pa.Array) -> pa.Array:
        mine = centroids[cluster.to_numpy(zero_copy_only=False)]
        return pa.array(squared(_vectors(packed, components), mine))

    found = rows.select("vec_id", "cluster", distance("v", "cluster").alias("distance"))
    digests = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in centroids.tolist()]
    sums = {row["cluster"]: row["total"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    # One row per centroid that has vectors.
    facts = rows.sparkSession.createDataFrame(
        [(number, total, sum(sums.values()), digests[number]) for number, total in sums.items()],
        "of int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("of")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
