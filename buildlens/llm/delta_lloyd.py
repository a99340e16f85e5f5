"""Centroid clustering by delta rounds of Lloyd's algorithm, in exact integers.

Every vector carries its owner and its distance to it, and the sums and counts of all
clusters are kept from round to round.  After centroids moved, a vector whose owner stayed
is compared with the moved centroids only: the others are as far as they were.  A vector
whose owner moved is compared with all.  Vectors that change owners then add to the sums of
the new one and take from the old, and only these signed transfers are aggregated.

Assignments are written to the shared checkpoint folder each round, so a lost executor costs
the tasks of that round.  The driver holds k centroids and sums, of DIM numbers each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, checkpoint, column, table

DIM = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Components of greater size stop the job: sums of squares of them would leave 64 bits.
LARGEST = 1 << 27
#: Up to this size, sums of products are exact in double precision.
_EXACT = 1 << 22
_STATE = "vec_id bigint, __v binary, __old int, cluster int, distance bigint"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors of int64 that are kept as one binary cell each."""
    if not len(col):
        return np.zeros((0, dim), np.int64)
    data = np.frombuffer(b"".join(col.to_pylist()), dtype=np.int32)
    return data.reshape(-1, dim).astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        dot = (x.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        dot = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]


def reassign(x: np.ndarray, owner: np.ndarray, far: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after the centroids `moved` (numbers) moved; owner -1: none so far.

    The least number wins among equal distances.
    """
    owner, far = owner.copy(), far.copy()
    lost = (owner < 0) | np.isin(owner, moved)
    if lost.any():
        d = distances(x[lost], centroids)
        best = d.argmin(axis=1)
        owner[lost], far[lost] = best, d[np.arange(len(d)), best]
    kept = np.flatnonzero(~lost)
    if len(kept) and len(moved):
        d = distances(x[kept], centroids[moved])
        best = d.argmin(axis=1)
        near, number = d[np.arange(len(d)), best], moved[best]
        better = (near < far[kept]) | ((near == far[kept]) & (number < owner[kept]))
        owner[kept[better]], far[kept[better]] = number[better], near[better]
    return owner, far


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and __v, the components times `scale` rounded down, of the vectors with `dim` finite components."""
    bound_batches(vectors.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    cells = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), cells.alias("__x")).where((F.size("__x") == dim) & F.forall("__x", finite))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(column(batch, "__x").flatten().to_numpy().reshape(-1, dim) * float(scale))
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"components over {LARGEST // scale} leave the range of exact 64-bit distances")
            v = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), v], names=["vec_id", "__v"])

    return rows.mapInArrow(run, "vec_id bigint, __v binary")


def first_centroids(whole: DataFrame, clusters: int, seed: int, dim: int = DIM) -> np.ndarray:
    """The vectors with the least hashes of their ids, in that order: a top-k in every task, then one of k rows a task."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = whole.select("__v", digest.alias("h")).orderBy("h", F.hex("__v")).limit(clusters).toArrow()
    return _matrix(got["__v"].combine_chunks(), dim) if got.num_rows else np.zeros((0, dim), np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = column(batch, "cluster").to_numpy()
            owner, far = reassign(_matrix(column(batch, "__v"), dim), old, column(batch, "distance").to_numpy(), centroids, moved)
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "__v"), pa.array(old), pa.array(owner.astype(np.int32)), pa.array(far)], names=["vec_id", "__v", "__old", "cluster", "distance"])

    return state.mapInArrow(run, _STATE)


def _transfers(state: DataFrame, clusters: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the clusters' sums and counts gain or lose by the vectors that changed owners.

    A task sums up all of its vectors before anything is shuffled: at most clusters * dim rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dim + 1), np.int64)
        for batch in batches:
            x = _matrix(column(batch, "__v"), dim)
            x = np.column_stack([x, np.ones(len(x), np.int64)])
            for owners, sign in ((column(batch, "cluster").to_numpy(), 1), (column(batch, "__old").to_numpy(), -1)):
                for c in np.unique(owners[owners >= 0]):
                    total[c] += sign * x[owners == c].sum(axis=0)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d])], names=["c", "d", "s"])

    moved = state.where(F.col("__old") != F.col("cluster")).select("__v", "__old", "cluster")
    got = moved.mapInArrow(run, "c int, d int, s bigint").groupBy("c", "d").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((clusters, dim + 1), np.int64)
    out[got["c"].to_numpy(), got["d"].to_numpy()] = got["s"].to_numpy()
    return out[:, :dim], out[:, dim]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the final centroids).

    Vectors that are null, of another length, or hold a null or a number that isn't finite are
    left out.  Ties of distance go to the smaller number; rows that repeat count each, a null
    vec_id is hashed as an empty one.  With fewer vectors than clusters there are as many
    centroids as vectors; an empty table gives an empty one.  Other columns are not read.
    """
    whole = checkpoint(whole_vectors(vectors, dim))
    centroids = first_centroids(whole, clusters, seed, dim)
    k = len(centroids)
    state = whole.select("vec_id", "__v", F.lit(-1).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    moved = np.arange(k)
    for r in range(rounds + 1 if k else 0):
        state = checkpoint(_assigned(state, centroids, moved))
        if r == rounds:
            break
        gain, more = _transfers(state, k, dim)
        sums, counts = sums + gain, counts + more
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved = np.flatnonzero((new != centroids).any(axis=1))
        centroids = new
        if not len(moved):
            break  # all later rounds would leave everything as it is
    return state.select("vec_id", "cluster", "distance"), centroids


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    hashes = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = sums.join(spark.createDataFrame(hashes, "cluster int, centroid_sha256 string"), "cluster")
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    of_cluster = named.crossJoin(F.broadcast(total))  # a single row
    return rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most CLUSTERS rows


def _op11_sql() -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::bigint"
    parts = [
        "e as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = 64)",
        "c0 as materialized (select (row_number() over (order by sha256('2:' || vec_id::varchar)) - 1)::integer as k, v from e order by sha256('2:' || vec_id::varchar) limit 40)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} as (select v.vec_id, v.v, c.k, {distance} as d from e v, c{r} c)")
        parts.append(f"a{r} as materialized (select vec_id, any_value(v) as v, arg_min(k, (d, k)) as k, min(d) as d from d{r} group by vec_id)")
        if r < ROUNDS:
            parts.append(f"m{r} as (select k, i, (sum(v[i])::hugeint - ((sum(v[i])::hugeint % count(*)) + count(*)) % count(*)) // count(*) as f from a{r}, range(1, 65) t(i) group by k, i)")
            parts.append(f"n{r} as (select k, list(f::bigint order by i) as v from m{r} group by k)")
            parts.append(f"c{r + 1} as materialized (select c.k, coalesce(n.v, c.v) as v from c{r} c left join n{r} n using (k))")
    last = ROUNDS
    return "with " + ",\n".join(parts) + f"""
select vec_id, k as cluster, d as distance, sum(d) over (partition by k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{last} join c{last} c using (k)"""


def queries() -> dict:
    return {"op11_delta_lloyd": op11_delta_lloyd}


def oracle_sql() -> dict[str, str]:
    return {"op11_delta_lloyd": _op11_sql()}
