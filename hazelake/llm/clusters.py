"""Clustering around centroids, nearest ones found by Orchard's search.

Vectors become integers, so sums, means and distances are exact and no result depends on the order of rows. A
search knows, for each centroid, the others by distance. A vector starts at some centroid and walks down that one's
list; whenever a centroid is nearer, it goes on in the list of that one. Centroids already visited are passed over.
It stops at a neighbour strictly beyond twice the present distance: by the triangle inequality none from there on is
nearer, and one exactly as near, which wins with a smaller number, is never beyond it.

Vectors stay where they are: a task sums up what it has read by cluster, and only these sums (clusters x
components per task) are shuffled, so a value that a third of all rows share is no hot key. The driver holds the
centroids. Search lists take the square of their number in every task.

Nulls: vectors of another length, with null or with non-finite components are left out. Scaled components beyond
2**26 would make distances that no long holds: such vectors are returned with their id and nulls, and count for
nothing. A null id is hashed as an empty one; repeated rows are vectors of their own, but of equal ids the smaller
vector comes first as a starting centroid. Fewer vectors than centroids asked for: as many centroids as vectors.
Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazelake.llm.common import written

CENTROIDS = 16
ROUNDS = 3
COMPONENTS = 64
SCALE = 64.0
#: with components up to this, four times a squared distance fits a long for up to 64 components and more
MOST = 1 << 26


class Search:
    """Orchard's search among ``centres`` (rows of integers)."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        k = len(centres)
        between = np.empty((k, k), dtype=np.int64)
        for i in range(k):
            between[i] = _squared(centres - centres[i])
        self.lists = np.argsort(between, axis=1, kind="stable")
        self.away = np.take_along_axis(between, self.lists, axis=1)
        self.looked_at = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centre, squared distance) of each point; of equals the smaller number."""
        n, k = len(points), len(self.centres)
        best = np.zeros(n, dtype=np.int64)
        far = _squared(points - self.centres[0])
        at = np.zeros(n, dtype=np.int64)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        live = np.arange(n)
        while len(live):
            live = live[at[live] < k]
            live = live[self.away[best[live], at[live]] <= 4 * far[live]]
            other = self.lists[best[live], at[live]]
            at[live] += 1
            fresh = ~seen[live, other]
            tried, other = live[fresh], other[fresh]
            seen[tried, other] = True
            self.looked_at += len(tried)
            found = _squared(points[tried] - self.centres[other])
            nearer = (found < far[tried]) | (found == far[tried]) & (other < best[tried])
            moved = tried[nearer]
            best[moved], far[moved], at[moved] = other[nearer], found[nearer], 0
        return best, far


def _squared(differences: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", differences, differences)


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _scaled(size: int, scale: float):
    """Components as integers, null for a vector that has one out of range."""

    def run(batches):
        for batch in batches:
            values = np.floor(_matrix(batch.column(1), size) * scale)
            fits = (np.abs(values) <= MOST).all(axis=1)
            whole = np.where(fits[:, None], values, 0).astype(np.int64)
            ends = np.r_[0, np.cumsum(np.where(fits, size, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(whole[fits].ravel()), mask=pa.array(~fits))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "point"])

    return run


def points_of(vectors: DataFrame, size: int, scale: float, key: str, column: str) -> DataFrame:
    """(id, point): vectors of ``size`` finite components as integers, written once and read in every round."""
    values = F.col(column).cast("array<double>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("id"), values.alias("v"), sound.alias("ok")).where((F.size("v") == size) & F.col("ok"))
    return written(kept.select("id", "v").mapInArrow(_scaled(size, scale), "id long, point array<long>"), "points")


def _first_centres(points: DataFrame, k: int) -> np.ndarray:
    """The ``k`` points with the smallest hashes of their ids."""
    ranked = points.where("point IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    return np.array([r["point"] for r in ranked.orderBy("h", "point").limit(k).collect()], dtype=np.int64)


def _sums(centres: np.ndarray):
    """Per task and cluster: members and sums of components."""

    def run(batches):
        search, k = Search(centres), len(centres)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros_like(centres)
        for batch in batches:
            points = _matrix(batch.column(0), centres.shape[1])
            best, _ = search.nearest(points)
            order = np.argsort(best, kind="stable")
            met, first = np.unique(best[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(points[order], first, axis=0)
                counts += np.bincount(best, minlength=k)
        met = np.flatnonzero(counts)
        if len(met):
            columns = [pa.array(met), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    return run


def _moved(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres after one round: floors of the means of their members, the same where there is none."""
    parts = points.where("point IS NOT NULL").select("point").mapInArrow(_sums(centres), "cluster long, n long, sums array<long>")
    wide = "decimal(38,0)"
    by_component = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("s").cast(wide)).alias("s")
    )
    out = centres.copy()
    for r in by_component.collect():  # clusters x components
        out[r["cluster"], r["i"]] = int(r["s"]) // int(r["n"])
    return out


def _assigned(centres: np.ndarray):
    def run(batches):
        search = Search(centres) if len(centres) else None
        for batch in batches:
            held = batch.column(1).is_valid()
            cluster, distance = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            rows = np.flatnonzero(held.to_numpy(zero_copy_only=False))
            if len(rows):
                cluster[rows], distance[rows] = search.nearest(_matrix(batch.column(1).drop_null(), centres.shape[1]))
            out = np.ones(batch.num_rows, dtype=bool)
            out[rows] = False
            columns = [batch.column(0), pa.array(cluster, pa.int32(), mask=out), pa.array(distance, mask=out)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return run


def clustered(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: float = SCALE,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """Per vector: its id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components)."""
    spark = vectors.sparkSession
    points = points_of(vectors, size, scale, key, column)
    centres = _first_centres(points, k)
    for _ in range(rounds if len(centres) else 0):
        centres = _moved(points, centres)
    found = written(points.mapInArrow(_assigned(centres), "id long, cluster int, distance long"), "clusters")
    wide = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in wide.collect()}  # one row per cluster
    rows = [(c, Decimal(s), Decimal(sum(inertia.values())), centres[c].tolist()) for c, s in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    joined = found.join(F.broadcast(facts), "cluster", "left")
    whole = [F.col(c).try_cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
    return joined.select(F.col("id").alias(key), "cluster", "distance", *whole, "centroid")


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: float = SCALE) -> str:
    """The same over the table ``embeddings``, every vector compared with every centroid."""
    steps = [
        f"""points AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale!r} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""centres0 AS (SELECT row_number() OVER (ORDER BY h, p) - 1 AS cluster, p AS c FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, p FROM points ORDER BY h, p LIMIT {k}))""",
    ]
    near = """near{i} AS (SELECT * FROM (SELECT r, vec_id, p, cluster, distance, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS rn FROM (
  SELECT *, list_sum(list_transform(list_zip(p, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance FROM points, centres{i})) WHERE rn = 1)"""
    for i in range(rounds):
        steps += [near.format(i=i), f"""centres{i + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM centres{i} LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
    SELECT cluster, i, sum(p[i]) AS s, count(*) AS n FROM near{i}, range(1, {size} + 1) AS g(i) GROUP BY 1, 2) GROUP BY 1) USING (cluster))"""]
    steps.append(near.format(i=rounds))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(n.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} AS n JOIN centres{rounds} AS c ON n.cluster = c.cluster"""
