"""Clustering by plain Lloyd rounds over whole numbers.

A component x of a vector becomes floor(256 x). Centroids start as the vectors whose hashed ids are smallest. In each round the centroids are
broadcast (at most `clusters` vectors, however large the table is), `mapInPandas` takes the squared differences to one centroid after
another in NumPy, and argmin gives the lowest number among equals. A task returns one sum per cluster, digit and component; groupBy merges
them. Every number is a whole one, so neither the split of the table nor the order of its rows changes a result.

The table is read once per round and never rewritten; only (id, cluster, distance) of the last round goes to the shared folder.

Defined results: vectors that don't have exactly `dims` components, or have one that is null or not finite, are left out, and so are null
vectors; a null id is kept, and taken for a centroid only after all others; repeated ids are vectors of their own, those under one id ordered
by their components; with fewer vectors than clusters each is a centroid; equal centroids leave the later ones empty, which
stay where they are; an empty table gives an empty result; a distance or inertia above the largest long is null, while
the rounds still go by its exact value; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import cut, prepare

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: With components below this, squared distances of up to 256 components fit in 64 bits; larger ones are taken as Python's numbers.
SMALL = 1 << 26
LARGEST = (1 << 63) - 1
#: Sums travel in digits of so many bits, each of which Spark can add up 2^23 times and more.
DIGIT = 40


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) of each component, exactly."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], dtype=object)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its centroid's number, the lowest of equally near ones, and the squared distance."""
    kind = np.int64 if vectors.dtype != object and centroids.dtype != object else object
    distances = np.empty((len(centroids), len(vectors)), kind)
    for k, c in enumerate(centroids.astype(kind)):
        off = vectors.astype(kind, copy=False) - c
        distances[k] = np.einsum("ij,ij->i", off, off) if kind is np.int64 else (off * off).sum(axis=1)
    best = distances.argmin(axis=0)
    return best.astype(np.int32), distances[best, np.arange(len(vectors))]


def digits(value: int) -> list[int]:
    """The value's digits to the base 2^DIGIT, lowest first, all with its sign."""
    out, rest, sign = [], abs(value), -1 if value < 0 else 1
    while rest:
        out.append(sign * (rest & ((1 << DIGIT) - 1)))
        rest >>= DIGIT
    return out


def packed(rows: np.ndarray) -> np.ndarray:
    """As 64-bit numbers where all are small enough."""
    return rows.astype(np.int64) if all(abs(x) < SMALL for x in rows.ravel().tolist()) else rows


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, vector) of the vectors that take part."""
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") == dims) & fit)


def first_centroids(rows: DataFrame, clusters: int, scale: int, seed: int) -> np.ndarray:
    """The vectors whose sha256 of `seed:id` come first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), F.col("vector")).limit(clusters).collect()
    return whole(np.array([r.vector for r in chosen], np.float64), scale) if chosen else np.zeros((0, 0), np.int64)


def lloyd_round(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid that has vectors moves to the floor of their mean."""
    k, dims = centroids.shape
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for x in batches:
            vectors = whole(np.stack(x.vector.to_numpy()), scale)
            best, _ = nearest(vectors, sent.value)
            for c in np.unique(best).tolist():
                mine = vectors[best == c]
                sums[c] += np.array([int(s) for s in mine.sum(axis=0)], object)
                counts[c] += len(mine)
        out = []
        for c in np.flatnonzero(counts).tolist():
            parts = [digits(s) for s in sums[c]]
            for place in range(max(1, *map(len, parts))):
                out.append([c, place, int(counts[c]) if not place else 0, *(p[place] if place < len(p) else 0 for p in parts)])
        yield pd.DataFrame(out, columns=["cluster", "place", "n", *names])

    names = [f"s{i}" for i in range(dims)]
    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("place", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", *names))]
    merged = rows.select("vector").mapInPandas(summed, T.StructType(fields)).groupBy("cluster", "place").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
    sent.unpersist()
    total, count = np.zeros((k, dims), object), [0] * k
    for r in merged:
        total[r.cluster] += np.array([r[c] << (DIGIT * r.place) if r[c] >= 0 else -(-r[c] << (DIGIT * r.place)) for c in names], object)
        count[r.cluster] += r.n
    return packed(np.array([[s // count[c] for s in total[c]] if count[c] else centroids[c].tolist() for c in range(k)], object))


def assign(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, cluster, distance)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            best, distance = nearest(whole(np.stack(x.vector.to_numpy()), scale), sent.value)
            yield pd.DataFrame({"vec_id": x.vec_id, "cluster": best, "distance": pd.array([d if d <= LARGEST else None for d in distance.tolist()], "Int64")})

    return rows.mapInPandas(assigned, T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, id_col, vector_col, dims)
    centroids = first_centroids(rows, clusters, scale, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid"))
    for _ in range(rounds):
        centroids = lloyd_round(rows, centroids, scale)
    found = cut(assign(rows, centroids, scale))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: None if r.over else int(r.total) for r in found.groupBy("cluster").agg(exact.alias("total"), F.max(F.col("distance").isNull()).alias("over")).collect()}
    known = lambda x: x if x is not None and x <= LARGEST else None
    every = known(None if None in sums.values() else sum(sums.values()))
    told = [(c, known(x), every, ",".join(map(str, centroids[c].tolist()))) for c, x in sums.items()]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def report(vectors: DataFrame) -> DataFrame:
    """The contracted columns: centroids as digests."""
    found = centroid_clusters(vectors)
    return found.withColumn("centroid_sha256", F.sha2(F.col("centroid").cast("binary"), 256)).drop("centroid")


def brute_force(vectors: list[list[float]], ids: list[int], clusters: int, rounds: int, scale: int = SCALE, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(id, cluster, distance) by plain loops, for tests."""
    import math

    rows = [[math.floor(x * scale) for x in v] for v in vectors]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), vectors[i]))
    centres = [rows[i] for i in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for v in rows]
        for k in range(len(centres)):
            if mine := [v for v, a in zip(rows, at) if a == k]:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in zip(ids, rows)]


def _oracle() -> str:
    """The same rounds in SQL, over one row per vector and component."""
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f""",
near{r} AS MATERIALIZED (
  SELECT rid, CAST(min(far * 64 + c) % 64 AS INTEGER) AS cluster, CAST(min(far * 64 + c) // 64 AS BIGINT) AS distance
  FROM (SELECT p.rid, m.c, sum((p.x - m.x) * (p.x - m.x)) AS far FROM parts p JOIN mean{r} m ON p.i = m.i GROUP BY p.rid, m.c) GROUP BY rid)"""
        if r < ROUNDS:
            rounds += f""",
moved{r} AS (SELECT n.cluster AS c, p.i, sum(p.x) AS s, count(*) AS n FROM parts p JOIN near{r} n ON p.rid = n.rid GROUP BY n.cluster, p.i),
mean{r + 1} AS MATERIALIZED (
  SELECT m.c, m.i, CASE WHEN v.n IS NULL THEN m.x ELSE CAST((v.s - ((v.s % v.n) + v.n) % v.n) // v.n AS BIGINT) END AS x
  FROM mean{r} m LEFT JOIN moved{r} v ON m.c = v.c AND m.i = v.i)"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), embedding) AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {DIMS}),
parts AS MATERIALIZED (SELECT rid, unnest(range(1, {DIMS + 1})) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
mean0 AS MATERIALIZED (SELECT rid - 1 AS c, i, x FROM parts WHERE rid <= {CLUSTERS}){rounds},
sums AS (SELECT cluster, sum(distance) AS s FROM near{ROUNDS} GROUP BY cluster),
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM mean{ROUNDS} GROUP BY c)
SELECT k.vec_id, n.cluster, n.distance, CAST(s.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM sums) AS BIGINT) AS inertia, d.h AS centroid_sha256
FROM kept k JOIN near{ROUNDS} n ON k.rid = n.rid JOIN sums s ON n.cluster = s.cluster JOIN named d ON d.c = n.cluster"""


ORACLE = _oracle()
