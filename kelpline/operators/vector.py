"""Vector search as a top-k join."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Queries of a block and vectors of a shard, on average; a matrix of distances has STEP queries and four times as many vectors.
BLOCK, ROWS, STEP = 2048, 16384, 1024
_FOUND = "query_id {}, vec_id {}, distance double"


def _rounded(d: np.ndarray) -> np.ndarray:
    """d to six places, halves up, as Spark rounds a double: by its shortest decimal form."""
    with np.errstate(invalid="ignore"):
        x = d * 1e6
        out = np.floor(x + 0.5) / 1e6
        doubt = np.isfinite(d) & ((np.abs(x - np.floor(x) - 0.5) <= 1e-14 * x + 1e-12) | (d > 1e9))
    for i in np.nonzero(doubt)[0]:
        out[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if d[i] < 1e20 else d[i]
    return out


def _dense(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists -> (values, a row each, zero where there is none; where there is one; length, -1 for a null)."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = np.asarray(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = lists.flatten()
    mask = np.arange(max(size.max(initial=0), 1))[None, :] < size[:, None]
    values = np.zeros(mask.shape)
    values[mask] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    mask[mask] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, mask, size


def _all(q: np.ndarray, has_q: np.ndarray, v: np.ndarray, has_v: np.ndarray) -> np.ndarray:
    """Distances of all pairs over the places that both have, summed in order; -1 where there is none."""
    total, any_ = np.zeros((len(q), len(v))), np.zeros((len(q), len(v)), bool)
    with np.errstate(invalid="ignore", over="ignore"):
        for j in range(min(q.shape[1], v.shape[1])):
            both = has_q[:, j][:, None] & has_v[:, j][None, :]
            step = q[:, j][:, None] - v[:, j][None, :]
            total += np.where(both, step * step, 0.0)
            any_ |= both
        return np.where(any_, np.sqrt(total), -1.0)


def _doubtful(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of v) of the pairs that a matrix product can't rule out of the k nearest by distance to six places."""
    if len(v) <= k:
        at, row = np.indices((len(q), len(v)))
        return at.ravel(), row.ravel()
    top = (q * q).sum(1).max() + (v * v).sum(1).max()
    near = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (q @ v.T)
    kth = np.partition(near, k - 1, axis=1)[:, k - 1]
    # Rounding errors of both sides, with room to spare, and a unit of the sixth place.
    slack = 8.0 * (v.shape[1] + 4) * np.finfo(np.float64).eps * top
    limit = (np.sqrt(np.maximum(kth + slack, 0.0)) + 2e-6) ** 2 + slack
    return np.nonzero(near <= limit[:, None])


def nearest(ids: np.ndarray, v: tuple, q: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k nearest vectors by (distance to six places, nulls last; id): (row of q, row of ids, distance), -1 for null.

    v and q are as `_dense` gives them. Rows without gaps and of the queries' usual length go through matrix products that
    leave few pairs; these, and all pairs of other rows, have their distances summed in the order of the dimensions.
    """
    (vx, has_v, size_v), (qx, has_q, size_q) = v, q
    wide = int(np.bincount(np.maximum(size_q, 0)).argmax()) if len(size_q) else 0

    def plain(x, has, size):
        return (size == wide) & has[:, :wide].all(1) & (np.abs(x[:, :wide]) < 1e100).all(1) if 0 < wide <= x.shape[1] else np.zeros(len(x), bool)

    even_v, even_q = plain(vx, has_v, size_v), plain(qx, has_q, size_q)
    found: list[tuple] = []
    a, b = np.nonzero(even_q)[0], np.nonzero(even_v)[0]
    for i in range(0, len(a), STEP):
        for j in range(0, len(b), STEP * 4):
            ai, bj = a[i : i + STEP], b[j : j + STEP * 4]
            at, row = _doubtful(qx[ai][:, :wide], vx[bj][:, :wide], k)
            total = np.zeros(len(at))
            for d in range(wide):
                step = qx[ai, d][at] - vx[bj, d][row]
                total += step * step
            found.append(_best(ai[at], bj[row], np.sqrt(total), ids, k))
    odd = np.nonzero(~even_v)[0]
    for rows_q, rows_v in ((np.nonzero(~even_q)[0], np.arange(len(vx))), (a, odd)):
        for i in range(0, len(rows_q), STEP):
            for j in range(0, len(rows_v), STEP):
                ai, bj = rows_q[i : i + STEP], rows_v[j : j + STEP]
                at, row = (x.ravel() for x in np.indices((len(ai), len(bj))))
                found.append(_best(ai[at], bj[row], _all(qx[ai], has_q[ai], vx[bj], has_v[bj]).ravel(), ids, k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, row, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return _best(at, row, d, ids, k, done=True)


def _best(at: np.ndarray, row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int, done: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k pairs of each query."""
    d = d if done else np.where(d < 0, d, _rounded(d))
    order = np.lexsort((ids[row], d, d < 0, at))
    at, row, d = at[order], row[order], d[order]
    first = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1)) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    keep = place < k
    return at[keep], row[keep], d[keep]


def _cell(k: int, shape: pa.Schema):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return shape.empty_table()
        # Places of the ids, nulls last, stand for them.
        order = np.empty(len(vectors), np.int64)
        order[pa.compute.sort_indices(vectors["vec_id"]).to_numpy()] = np.arange(len(vectors))
        at, row, d = nearest(order, _dense(vectors["embedding"]), _dense(queries["asked"]), k)
        columns = [queries["query_id"].take(pa.array(at)), vectors["vec_id"].take(pa.array(row)), pa.array(d, mask=d < 0)]
        return pa.table(columns, names=shape.names).cast(shape)

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """(vec_id, embedding) x (query_id, embedding) -> query_id, vec_id, distance (L2), score 1 / (1 + distance), rank from 0.

    Every query meets every vector, in cells of a block of queries and a shard of vectors, both of bounded size; a cell
    hands on the k best of each of its queries. Places that a query or a vector lacks don't count; a pair that shares none has
    no distance and stands last.
    """
    parts, shards = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // rows))
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("vec_id", "embedding", cut("vec_id", shards).alias("shard")).withColumn("part", every(parts))
    q = queries.select("query_id", F.col("embedding").alias("asked"), cut("query_id", parts).alias("part")).withColumn("shard", every(shards))
    schema = _FOUND.format(dict(q.dtypes)["query_id"], dict(v.dtypes)["vec_id"])
    pair = v.groupBy("part", "shard").cogroup(q.groupBy("part", "shard")).applyInArrow(_cell(k, to_arrow_schema(StructType.fromDDL(schema))), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("vec_id").asc_nulls_last()))
    best = pair.withColumn("n", rank).filter(F.col("n") <= k)
    return best.select("query_id", "vec_id", "distance", F.round(1 / (1 + F.col("distance")), 6).alias("score"), (F.col("n") - 1).alias("rank"))
