"""Clusters by Shallot search against plain k-means in whole numbers, and SQL."""

from __future__ import annotations

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boxmetrics.llm import clustering, sql
from boxmetrics.llm.clustering import Shallot, State

SCHEMA = "vec_id long, embedding array<float>, label int"


def _distances(vectors, centroids):
    return ((vectors[:, None, :].astype(object) - centroids[None].astype(object)) ** 2).sum(2)


def _plain(vectors, centroids, rounds):
    """Assignment and centroids; every distance is computed."""
    centroids = centroids.copy()
    for _ in range(rounds):
        nearest = _distances(vectors, centroids).argmin(1)
        for number in range(len(centroids)):
            own = vectors[nearest == number]
            if len(own):
                centroids[number] = [sum(column) // len(own) for column in own.T.tolist()]
    found = _distances(vectors, centroids)
    return found.argmin(1), found.min(1), centroids


def test_search_agrees_with_all_distances():
    """Few values give many equal distances; some vectors are all alike."""
    rng = np.random.default_rng(1)
    for trial in range(200):
        rows, size, reach = int(rng.integers(1, 200)), int(rng.integers(1, 6)), [2, 50, 100_000][trial % 3]
        vectors = rng.integers(-reach, reach, (rows, size)).astype(np.int32)
        if trial % 4 == 0:
            vectors[: rows // 2] = vectors[0]
        centroids = vectors[: min(rows, int(rng.integers(1, 20)))].astype(np.int64)
        state, before = State.unknown(rows, len(centroids)), None
        for rounds in range(6):
            Shallot(centroids, before).assign(vectors, state)
            distances = _distances(vectors, centroids)
            assert state.cluster.tolist() == distances.argmin(1).tolist()
            # The bounds hold, up to the margin they are used with.
            own = np.sqrt(distances[np.arange(rows), state.cluster].astype(float))
            assert (own <= state.upper * (1 + 1e-9)).all()
            sums = {n: (int((state.cluster == n).sum()), vectors[state.cluster == n].astype(int).sum(0).tolist()) for n in set(state.cluster.tolist())}
            before, centroids = centroids, clustering._moved(centroids, sums)


def test_settled_vectors_are_not_searched(monkeypatch):
    """Once the centroids stand still, no distance is computed any more."""
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(at, 2, (300, 8)) for at in (0, 500, 1000, 1500)]).astype(np.int32)
    centroids = vectors[[0, 300, 600, 900]].astype(np.int64)
    state = State.unknown(len(vectors), 4)
    Shallot(centroids).assign(vectors, state)
    asked = []
    search = Shallot(centroids, centroids)
    monkeypatch.setattr(search, "_search", lambda *args: asked.append("searched"))
    search.assign(vectors, state)
    assert not asked


def _expected(rows, count, rounds, size):
    kept = [
        (key, np.array([math.floor(256 * float(x)) for x in v], dtype=object))
        for key, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return collections.Counter()

    def place(row):
        hashed = None if row[0] is None else hashlib.sha256(f"2:{row[0]}".encode()).hexdigest()
        return (hashed is None, hashed or "", np.array(row[1], dtype="<i4").tobytes())

    start = np.stack([v for _, v in sorted(kept, key=place)[:count]])
    nearest, distance, centroids = _plain(np.stack([v for _, v in kept]), start, rounds)
    inertia = collections.Counter()
    for number, far in zip(nearest, distance):
        inertia[int(number)] += int(far)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return collections.Counter(
        (key, int(n), int(far), inertia[int(n)], sum(inertia.values()), digests[int(n)])
        for (key, _), n, far in zip(kept, nearest, distance)
    )


def _rows(size):
    rng = np.random.default_rng(7)
    made = [(n, (rng.normal(n % 5, 0.4, size) / 4).astype(np.float32).tolist()) for n in range(400)]
    made += [(1000 + n, [0.25] * size) for n in range(150)]
    made += [made[3]] * 60 + [(3, made[9][1]), (None, made[5][1]), (None, None), (2000, None), (2001, [])]
    odd = [[0.5] * (size - 1), [0.5] * (size + 1), [None] + [0.5] * (size - 1)]
    odd += [[value] + [0.5] * (size - 1) for value in (float("nan"), float("inf"), -float("inf"))]
    return made + [(3000 + n, v) for n, v in enumerate(odd)]


@pytest.mark.parametrize("count, rounds, size", [(40, 5, 64), (7, 2, 3), (1, 3, 4)])
def test_clusters_agree_with_plain_ones(spark, count, rounds, size):
    rows = _rows(size)
    frame = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA)
    frame = frame.withColumns({name: F.lit("other") for name in ("v", "cluster", "second", "upper", "distance", "of")})
    got = clustering.centroid_clusters(frame, count, rounds, size)
    assert collections.Counter(map(tuple, got.collect())) == _expected(rows, count, rounds, size)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (None, [0.1] * 64)]
    got = clustering.centroid_clusters(spark.createDataFrame([(*row, 1) for row in rows], SCHEMA))
    assert collections.Counter(map(tuple, got.collect())) == _expected(rows, 40, 5, 64)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        got = clustering.centroid_clusters(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == []
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_exact_distances_stop_the_job(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64, 1)], SCHEMA)
    with pytest.raises(Exception, match="no exact distances"):
        clustering.centroid_clusters(frame).collect()


def test_sql_agrees(spark):
    rows = [(n, [float(x) for x in v], 1) for n, (_, v) in enumerate(_rows(64)) if v and len(v) == 64 and None not in v]
    frame = spark.createDataFrame(rows, SCHEMA)
    connection = duckdb.connect()
    connection.register("embeddings", frame.toArrow())
    got = clustering.centroid_clusters(frame)
    wanted = connection.sql(f"SELECT {', '.join(got.columns)} FROM ({sql.op13()})").fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(wanted)
