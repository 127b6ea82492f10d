"""Centroid clustering by Exponion search, on integers.

Every vector keeps its centroid, an upper bound of its distance to it and a lower bound of its
distance to any other. After centroids moved, a vector whose bounds still part them is not
looked at again; any other scans only the centroids in a ball around its own, found as a prefix
of the list of all centroids in order of distance from that one. The ball of radius twice the
upper bound plus the way to the nearest other centroid holds the nearest and the second nearest;
it is closed, so that centroids at equal distance are in it. Vectors and bounds are a stored
table that each round writes anew; only centroids (a parameter's number) are on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import new_path, table

#: Number of centroids, rounds, components of a vector, and the factor before rounding down.
CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Components must be smaller: squared distances then fit a long.
LARGEST = 1 << 24
#: Bounds are widened by this share, which is far above what rounding can do.
SLACK = 1e-12

_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, scanned int, distance long"


def kept_vectors(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and v, whole numbers, of the vectors with exactly `dims` components, none null or non-finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    bound = F.forall(whole, lambda x: F.abs(x) < LARGEST)
    checked = F.when(bound, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is {LARGEST // SCALE} or more in size: distances would not fit a long")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of x by rows of c, as int64: by floating point where every sum fits 53 bits."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 2**53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    xi, ci = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((xi - one) ** 2).sum(1) for one in ci], axis=1) if len(ci) else np.zeros((len(xi), 0), dtype=np.int64)


@dataclass(frozen=True)
class Centroids:
    """Centroids with, for each, the others in order of distance, those distances, and how far each moved."""

    at: np.ndarray
    order: np.ndarray
    ways: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        ways = np.sqrt(squared(at, at).astype(np.float64))
        np.fill_diagonal(ways, -1)  # a centroid comes first in its own list
        order = np.argsort(ways, axis=1, kind="stable")
        ways = np.maximum(np.take_along_axis(ways, order, axis=1), 0)
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at.astype(np.float64) - before) ** 2).sum(1))
        return cls(at, order, ways, moved)

    def nearest_other(self) -> np.ndarray:
        return self.ways[:, 1] if len(self.at) > 1 else np.full(len(self.at), np.inf)

    def farthest_move(self) -> np.ndarray:
        """For each centroid the largest move of any other."""
        if len(self.at) < 2:
            return np.zeros(len(self.at))
        first, second = np.sort(self.moved)[::-1][:2]
        return np.where(np.arange(len(self.at)) == int(np.argmax(self.moved)), second, first)


def _two_nearest(distances: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and the squared distance of the next, -1 if there is none. names ascend."""
    at = np.argmin(distances, axis=1)
    best = distances[np.arange(len(distances)), at]
    if distances.shape[1] < 2:
        return names[at], best, np.full(len(distances), -1, dtype=np.int64)
    return names[at], best, np.partition(distances, 1, axis=1)[:, 1]


def first_search(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """cluster, upper, lower, scanned, from distances to all centroids."""
    cluster, best, second = _two_nearest(squared(x, c.at), np.arange(len(c.at)))
    lower = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0)) * (1 - SLACK))
    return cluster, np.sqrt(best) * (1 + SLACK), lower, np.full(len(x), len(c.at))


def exponion_search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """cluster, upper, lower, scanned after the centroids moved to c; scanned counts the distances computed.

    Bounds are strict: a vector as near to another centroid as to its own is always scanned.
    """
    cluster, scanned = cluster.copy(), np.zeros(len(x), dtype=np.int64)
    upper = (upper + c.moved[cluster]) * (1 + SLACK)
    lower = (lower - c.farthest_move()[cluster] * (1 + SLACK)) * (1 - SLACK)
    lower = np.where(np.isnan(lower), np.inf, lower)
    nearest = c.nearest_other()
    open_ = np.flatnonzero(~(upper < np.maximum(lower, nearest[cluster] * (1 - SLACK) / 2)))
    if len(open_):  # the bound may have grown loose: the distance itself
        own = ((x[open_].astype(np.int64) - c.at[cluster[open_]]) ** 2).sum(1)
        upper[open_], scanned[open_] = np.sqrt(own) * (1 + SLACK), 1
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], nearest[cluster[open_]] * (1 - SLACK) / 2))]
    was = cluster[open_]
    for a in np.unique(was):
        mine = open_[was == a]
        radius = (2 * upper[mine] + nearest[a]) * (1 + SLACK)
        inside = np.searchsorted(c.ways[a], radius, side="right")
        for n in np.unique(inside):
            some, names = mine[inside == n], np.sort(c.order[a, :n])
            cluster[some], best, second = _two_nearest(squared(x[some], c.at[names]), names)
            upper[some] = np.sqrt(best) * (1 + SLACK)
            lower[some] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0)) * (1 - SLACK))
            scanned[some] += n
    return cluster, upper, lower, scanned


def _assign(rows: DataFrame, c: Centroids, first: bool, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            if first:
                found = first_search(x, c)
            else:
                found = exponion_search(x, *(batch.column(n).to_numpy() for n in ("cluster", "upper", "lower")), c)
            cluster, upper, lower, scanned = found
            distance = ((x.astype(np.int64) - c.at[cluster]) ** 2).sum(1) if last else np.zeros(len(x), dtype=np.int64)
            columns = [batch.column("vec_id"), batch.column("v"), *(pa.array(a, t) for a, t in ((cluster, pa.int32()), (upper, pa.float64()), (lower, pa.float64()), (scanned, pa.int32()), (distance, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _STATE.split(", ")])

    return rows.mapInArrow(run, _STATE)


def exponion_clusters(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, upper, lower, scanned, distance; the final centroids). scanned counts distances of the last search.

    Vectors of another length, or with a null or non-finite component, are left out. Seeds are the
    vectors with the smallest hash of their id; of rows that repeat an id, the smaller vectors first,
    rows without an id last (they are assigned like any other). With fewer vectors than centroids each
    is a centroid. Equal centroids stay apart: their vectors go to the smaller number, and an empty one
    stays where it is. A component of 2^18 or more in size raises an error. Other columns are not read.
    """
    spark = embeddings.sparkSession
    kept = kept_vectors(embeddings, dims)
    label = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.orderBy(F.asc_nulls_last(label), "v").limit(centroids).collect()
    if not seeds:
        return spark.createDataFrame([], _STATE), []
    at, before, state, path = np.array([r["v"] for r in seeds], dtype=np.int64), None, kept, None
    for turn in range(rounds + 1):
        old, path = path, new_path(spark, f"clusters-{turn}")
        _assign(state, Centroids.of(at, before), turn == 0, turn == rounds).write.mode("overwrite").parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if old:  # nothing reads it any more
            gone = spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        if turn < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[k].cast("long")).alias(f"s{k}") for k in range(dims)]).collect()
            before, at = at, at.copy()
            for r in sums:
                at[r["cluster"]] = [r[f"s{k}"] // r["n"] for k in range(dims)]
    return state, at.tolist()


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, at = exponion_clusters(table(spark, sf_dir, "embeddings"))
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(at)]
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    figures = sums.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(whole))  # a row a centroid, and one row
    return state.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same clusters by distances to all centroids, round by round."""
    steps = [
        f"""k as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
 where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as (select cast(row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1 as int) as c, v as w from k qualify c < {CENTROIDS})",
    ]
    for turn in range(ROUNDS + 1):
        steps.append(f"""a{turn} as materialized (select row, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := d, c := c)) as n from
 (select row, vec_id, v, c, cast(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from k, c{turn}) group by row)""")
        if turn < ROUNDS:
            steps.append(f"""m{turn} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as w from
 (select n.c as c, i, cast(sum(v[i]) as bigint) as s, cast(count(*) as bigint) as n from a{turn}, range(1, {DIMS + 1}) as r(i) group by 1, 2) group by c),
c{turn + 1} as materialized (select c{turn}.c as c, coalesce(m{turn}.w, c{turn}.w) as w from c{turn} left join m{turn} using (c))""")
    return f"""with {",\n".join(steps)}
select vec_id, n.c as cluster, n.d as distance, cast(sum(n.d) over (partition by n.c) as bigint) as cluster_inertia, cast(sum(n.d) over () as bigint) as inertia,
 sha256(array_to_string(w, ',')) as centroid_sha256 from a{ROUNDS} join c{ROUNDS} on n.c = c{ROUNDS}.c"""
