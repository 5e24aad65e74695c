"""Approximate nearest neighbours by cosine over balanced posting lists.

An index is fitted on a bounded sample: centroids by k-means with a penalty on large clusters, a neighbour graph over
the centroids that is searched in memory, and the distance ratio up to which lists are searched. Every vector is then
put in the list of its nearest centroid and, near boundaries, in further lists (closure), unless a list already
chosen is nearer to that centroid than the vector is. A query searches all lists within the ratio of its nearest
centroid's distance; the ratio is the least one that reaches TARGET recall among the sample itself, whose neighbours
lie farther apart than those of the whole table, so the estimate errs on the side of searching more.

Lists are cut into chunks of about CHUNK vectors, so that a hot list is many tasks; a task holds one chunk at a time
and streams the queries past it. Scores are exact cosines of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace, tidy

#: Bounds of the fitted sample and of the centroids; vectors aimed at for a list, and held at a time.
SAMPLE, CENTROIDS, LIST, CHUNK = 32768, 4096, 1024, 4096
#: Graph: neighbours of a centroid, and beam of a search. Closure: lists of a vector at most, and how much farther they may be.
DEGREE, BEAM, REPLICAS, CLOSURE = 16, 1024, 4, 1.05
TARGET = 0.98


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class ListIndex:
    """Centroids, their graph, and the ratio of distances that bounds a search."""

    def __init__(self, sample: np.ndarray, n_lists: int, k: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        self.centroids = self._cluster(np.unique(x, axis=0), n_lists, rng)
        self._link(rng)
        self.ratio = self._fit_ratio(x, k, rng)

    @staticmethod
    def _cluster(x: np.ndarray, n: int, rng) -> np.ndarray:
        n = max(1, min(n, len(x)))
        centroids = x[rng.choice(len(x), n, replace=False)]
        sizes = np.full(n, len(x) / n)
        for _ in range(10):
            near = np.concatenate([(x[i : i + 4096] @ centroids.T - 0.05 * sizes / sizes.mean()).argmax(axis=1) for i in range(0, len(x), 4096)])
            sizes = np.bincount(near, minlength=n).astype(float)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, x)
            full = np.linalg.norm(sums, axis=1) > 1e-9
            centroids[full] = _unit(sums[full])
        return centroids

    def _link(self, rng) -> None:
        """Each centroid's nearest ones, and a ring over all so that the graph is connected."""
        n = len(self.centroids)
        near = np.argsort(-(self.centroids @ self.centroids.T), axis=1, kind="stable")[:, 1 : DEGREE + 1] if n > 1 else np.zeros((1, 0), np.int64)
        ring = rng.permutation(n)
        after = np.empty(n, np.int64)
        after[ring] = np.roll(ring, -1)
        self.graph = np.hstack([near, after[:, None]])
        self.entries = ring[: min(n, 8)]

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) by distance, rows x min(beam, lists): best-first walks over the graph, all rows at once."""
        n = len(self.centroids)
        beam = min(beam, n)
        rows = np.arange(len(x))
        dist = np.full((len(x), n), np.inf)
        open_ = np.full((len(x), n), np.inf)

        def look(at: np.ndarray) -> None:
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rkd,rd->rk", self.centroids[at], x)))
            new = np.isinf(dist[rows[:, None], at])
            open_[rows[:, None], at] = np.where(new, d, open_[rows[:, None], at])
            dist[rows[:, None], at] = d

        look(np.tile(self.entries, (len(x), 1)))
        for _ in range(beam):
            best = open_.argmin(axis=1)
            if np.isinf(open_[rows, best]).all():
                break
            open_[rows, best] = np.inf
            look(self.graph[best])
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(dist, order, axis=1)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists that each unit vector is put in, the nearest first."""
        order, dist = self.search(x, beam=64)
        out = []
        for lists, d in zip(order, dist, strict=True):
            chosen = [lists[0]]
            for c, far in zip(lists[1 : 4 * REPLICAS], d[1 : 4 * REPLICAS], strict=True):
                if far > CLOSURE * d[0] or len(chosen) == REPLICAS:
                    break
                if np.sqrt(np.maximum(0, 2 - 2 * (self.centroids[chosen] @ self.centroids[c]))).min() > far:
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def _fit_ratio(self, x: np.ndarray, k: int, rng) -> float:
        asks = rng.choice(len(x), min(len(x), 400), replace=False)
        lists = self.lists_of(x)
        near = x[asks] @ x.T
        near[np.arange(len(asks)), asks] = -9
        order, dist = self.search(x[asks])
        needed = []
        for row, q in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :k]):
            rank = np.full(len(self.centroids), np.inf)
            rank[order[row]] = dist[row] / max(dist[row, 0], 1e-9)
            needed += [rank[lists[v]].min() for v in q if v != asks[row]]
        finite = np.sort([r for r in needed if np.isfinite(r)])
        return float(finite[min(len(finite) - 1, int(np.ceil(TARGET * len(needed))))]) + 1e-9 if len(finite) else 1.0

    def to_search(self, x: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists that each unit query searches: those within the ratio, and as many as k + 1 vectors need."""
        order, dist = self.search(x)
        seen = np.cumsum(counts[order], axis=1)
        near = dist <= self.ratio * np.maximum(dist[:, :1], 1e-9)
        short = np.hstack([np.ones((len(x), 1), bool), seen[:, :-1] < k + 1])
        return [o[m] for o, m in zip(order, near | short, strict=True)]


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64) if len(column) else np.zeros((0, 1))


def _assign(index: ListIndex):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = index.lists_of(_unit(_matrix(batch.column(1))))
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                first = np.append(True, row[1:] != row[:-1])
                cols = [pa.array(np.concatenate(lists), pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(first.astype(np.int64))]
                yield pa.record_batch(cols, names=["list", "vec_id", "v", "primary"])

    return run


def _ask(index: ListIndex, counts: np.ndarray, chunks: np.ndarray, k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lists = index.to_search(_unit(_matrix(part.column(1))), counts, k)
                row = np.repeat(np.arange(len(lists)), [int(chunks[x].sum()) for x in lists])
                list_ = np.concatenate([np.repeat(x, chunks[x]) for x in lists])
                chunk = np.concatenate([np.arange(n) for x in lists for n in chunks[x]])
                cols = [pa.array(list_, pa.int32()), pa.array(chunk, pa.int32()), pa.array(np.ones(len(row)), pa.int32()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))]
                yield pa.record_batch(cols, names=["list", "chunk", "side", "vec_id", "v"])

    return run


def top(ids: np.ndarray, v: np.ndarray, query: int, q: np.ndarray, k: int, near: np.ndarray) -> list[tuple[int, int, float]]:
    """The k best ids of a chunk for one query, by exact score, then id; near holds its scores up to rounding.

    Rows that share an id lie side by side and count as its best one.
    """
    near = np.where(ids == query, -np.inf, near)
    new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    best = near if len(new) == len(ids) else np.maximum.reduceat(near, new)
    if len(best) > k:
        at = np.flatnonzero(near >= np.partition(best, -k)[-k] - 1e-9)
    else:
        at = np.arange(len(near))
    at = at[ids[at] != query]
    score = (v[at] * q).sum(axis=1) / (np.sqrt((v[at] * v[at]).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = np.lexsort((ids[at], -score))
    order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
    return [(query, int(ids[at][j]), float(score[j])) for j in order]


def _meet(k: int):
    """Rows sorted by (list, chunk, side): a chunk's vectors come first and stay while its queries pass."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, v = None, [], None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in (0, 1, 2)], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                list_, chunk, side = keys[a].tolist()
                part_ids, part = batch.column(3).slice(a, b - a).to_numpy(), _matrix(batch.column(4).slice(a, b - a))
                if (list_, chunk) != at:
                    at, held, ids = (list_, chunk), [], None
                if side == 0:
                    held.append((part_ids, part))
                    continue
                if ids is None and held:
                    ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    order = np.argsort(ids, kind="stable")
                    ids, v = ids[order], v[order]
                    unit = _unit(v)
                    held = []
                if ids is not None:
                    near = _unit(part) @ unit.T
                    for j in range(len(part)):
                        out += top(ids, v, int(part_ids[j]), part[j], k, near[j])
            yield pa.record_batch([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, n_lists: int | None = None, work: Workspace | None = None) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> query_id, rank (from 1), vec_id, score: each query's k nearest found.

    Nearness is the cosine; ties go to the smaller vec_id; a vector with the query's own id is no candidate.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
    ids; rows that repeat an id and its vector count once, other rows that share an id are candidates each, of which
    the best counts; vectors of different lengths never meet; with too few candidates all are returned.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark, "ann")

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        rows = rows.filter("vec_id is not null and v is not null and size(v) > 0")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.filter(finite).filter(F.exists("v", lambda x: x != 0))

    base, asks = clean(vectors).distinct(), clean(queries)
    found = None
    for size, n in sorted(base.groupBy(F.size("v")).count().collect()):
        rows, ask = base.filter(F.size("v") == size), asks.filter(F.size("v") == size)
        lists = n_lists or max(1, min(CENTROIDS, -(-n // LIST)))
        want = min(SAMPLE, n, max(64 * lists, 4096))
        sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, 1.1 * want / n) * (1 << 30))).limit(SAMPLE)
        taken = sample.select("v").collect()
        index = ListIndex(np.array([r.v for r in taken or rows.select("v").limit(SAMPLE).collect()], np.float64), lists, k)

        postings = work.save(rows.mapInArrow(_assign(index), "list int, vec_id long, v array<double>, primary long"), f"postings-{size}")
        sizes = {r["list"]: r for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("primary") == 1, F.col("vec_id"))).alias("p")).collect()}
        place = range(len(index.centroids))
        chunks = np.array([-(-sizes[c].n // CHUNK) if c in sizes else 0 for c in place])
        counts = np.array([sizes[c].p if c in sizes else 0 for c in place])
        cut = F.element_at(F.array(*[F.lit(int(max(1, c))) for c in chunks]), F.col("list") + 1)
        held = postings.select("list", F.pmod(F.xxhash64("vec_id"), cut).cast("int").alias("chunk"), F.lit(0).alias("side"), "vec_id", "v")
        asked = ask.distinct().mapInArrow(_ask(index, counts, chunks, k), "list int, chunk int, side int, vec_id long, v array<double>")
        meet = held.union(asked).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "side")
        part = meet.mapInArrow(_meet(k), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.range(0).selectExpr("id AS query_id", "cast(0 AS int) AS rank", "id AS vec_id", "0D AS score")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
