"""Hard negatives by inner product: inverted lists of k-means with the radius of each, searched by bound until nothing can follow.

Centroids are fitted on a bounded sample; every row is then put in its nearest list, and a list keeps how many rows it
has, the distance of its farthest row (its radius) and whether all its rows have one label. By Cauchy and Schwarz the
inner products of an anchor a with the rows of a list of centroid m and radius r lie within |a| r of a m. An anchor
visits lists by that upper bound; lists whose bounds miss its window of scores, or whose only label is of no use, are
skipped; it stops when the next bound is strictly below the worst of the k rows that it has. The result is exact.

Lists are visited in rounds, each GROW times as many lists as before: between rounds the best rows so far are merged
and saved, and anchors that are done ask no more. Lists are cut into chunks of about CHUNK rows, so that a hot list is
many tasks; a task holds one chunk and streams the asking anchors past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace, tidy

#: Bounds of the fitted sample and of the centroids; rows aimed at for a list, and held at a time.
SAMPLE, CENTROIDS, LIST, CHUNK = 32768, 4096, 512, 2048
#: Lists of the first round, and how many times as many each further round has.
FIRST, GROW = 4, 4

LEAST, MOST = -(1 << 63), (1 << 63) - 1
ASKS = "list int, chunk int, side int, vec_id long, label long, v array<long>, keys array<long>, lows array<long>, highs array<long>, kth array<long>"
FOUND = "anchor_id long, key long, score long, vec_id long"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal, non-null length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond 64 bits stop at its ends."""
    bound = q.shape[1] * int(np.abs(q.astype(np.float64)).max(initial=0)) * int(np.abs(v.astype(np.float64)).max(initial=0))
    if bound < 1 << 53:  # every partial sum is an integer that a double holds
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ v.T.astype(object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def fit(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of at most n clusters."""
    x = np.unique(sample.astype(np.float64), axis=0)
    rng = np.random.default_rng(seed)
    n = max(1, min(n, len(x)))
    centroids = x[np.sort(rng.choice(len(x), n, replace=False))]
    for _ in range(rounds):
        near, _ = nearest_list(x, centroids)
        sums, sizes = np.zeros_like(centroids), np.bincount(near, minlength=n)
        np.add.at(sums, near, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def nearest_list(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it) of each row."""
    own = (centroids * centroids).sum(axis=1) / 2
    near = np.concatenate([(own - x[i : i + 1024] @ centroids.T).argmin(axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))


class Lists:
    """What an anchor needs to know of all lists: centroids, radii, chunks, and the only label of each (if it has one)."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, chunks: np.ndarray, one: np.ndarray, only: np.ndarray):
        self.centroids, self.radii, self.chunks, self.one, self.only = centroids, radii, chunks, one, only
        self.lengths = np.sqrt((centroids**2).sum(axis=1))

    def order(self, a: np.ndarray, label: int, low: int, high: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(lists that may hold a row of use, by bound; their bounds): no score of the list, nor of any later one, is above its bound."""
        a = a.astype(np.float64)
        middle, norm = self.centroids @ a, np.sqrt((a * a).sum())
        slack = norm * self.radii + 1e-9 * norm * (self.lengths + self.radii) + 1e-6
        of_use = self.one & (self.only != label) if same else self.one & (self.only == label)
        at = np.flatnonzero((self.chunks > 0) & ~of_use & (middle + slack >= low) & (middle - slack <= high))
        bound = np.minimum(middle[at] + slack[at], high)
        by = np.lexsort((np.abs(middle[at] - min(high, 1e300)), -bound))
        return at[by], bound[by]


def _assign(centroids: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, far = nearest_list(matrix(batch.column(2)).astype(np.float64), centroids)
                yield pa.record_batch([pa.array(near, pa.int32()), pa.array(far), *batch.columns], names=["list", "far", *batch.schema.names])

    return run


def _visit(lists: Lists, first: int, to: int, same: bool):
    """The chunks that each anchor asks in this round: lists first .. to of its order, up to where it may stop."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, list_, chunk = [], [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                label, lows, highs, kth = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("label", "lows", "highs", "kth"))
                for j, a in enumerate(matrix(part.column(part.schema.get_field_index("v")))):
                    order, bound = lists.order(a, label[j], min(lows[j]), max(highs[j]), same)
                    order, bound = order[first:to], bound[first:to]
                    order = order[bound >= min(kth[j])]
                    n = lists.chunks[order]
                    list_.append(np.repeat(order, n))
                    chunk.append(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
                    rows.append(np.full(int(n.sum()), at + j))
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            cols = [pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (list_, chunk)]
            cols += [pa.array(np.ones(len(row)), pa.int32()), *(batch.column(batch.schema.get_field_index(c)).take(row) for c in ("vec_id", "label", "v", "keys", "lows", "highs", "kth"))]
            for at in range(0, len(row), 1024):
                yield pa.record_batch([c.slice(at, 1024) for c in cols], names=["list", "chunk", "side", "vec_id", "label", "v", "keys", "lows", "highs", "kth"])

    return run


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _score(k: int, same: bool):
    """Rows sorted by (list, chunk, side): a chunk's rows come first and stay while its anchors pass."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in (0, 1, 2)], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            out: list[tuple] = []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                list_, chunk, side = keys[a].tolist()
                part = batch.slice(a, b - a)
                if (list_, chunk) != at:
                    at, held, ids = (list_, chunk), [], None
                own, label, v = part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5))
                if side == 0:
                    held.append((own, label, v))
                    continue
                if ids is None and held:
                    ids, labels, rows = (np.concatenate([h[c] for h in held]) for c in range(3))
                    held = []
                if ids is None:
                    continue
                scores = products(v, rows)
                for j, needs in enumerate(zip(*(part.column(c).to_pylist() for c in (6, 7, 8, 9)), strict=True)):
                    fits = np.flatnonzero((labels == label[j]) & (ids != own[j]) if same else labels != label[j])
                    score, who = scores[j, fits], ids[fits]
                    for key, low, high, kth in zip(*needs, strict=True):
                        within = np.flatnonzero((score >= max(low, kth)) & (score <= high))
                        within = within[best(score[within], who[within], k)]
                        out += [(own[j], key, s, i) for s, i in zip(score[within].tolist(), who[within].tolist(), strict=True)]
            yield pa.record_batch([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=["anchor_id", "key", "score", "vec_id"])

    return run


class _Search:
    """The k best rows of use for each need (anchor, key, window of scores)."""

    def __init__(self, postings: DataFrame, lists: Lists, work: Workspace, name: str):
        cuts = postings.sparkSession.createDataFrame([(k, int(n)) for k, n in enumerate(lists.chunks) if n], "list int, cuts int")  # at most CENTROIDS rows
        rows = postings.join(F.broadcast(cuts), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
        none = F.array().cast("array<long>")
        self.rows = rows.select("list", "chunk", F.lit(0).alias("side"), "vec_id", "label", "v", *(none.alias(c) for c in ("keys", "lows", "highs", "kth")))
        self.lists, self.work, self.name = lists, work, name

    def run(self, anchors: DataFrame, needs: DataFrame, k: int, same: bool) -> DataFrame:
        """anchors (vec_id, label, v); needs (anchor_id, key, low, high) -> anchor_id, key, score, vec_id, rank."""
        first, to, turn, found = 0, FIRST, 0, None
        place = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
        while first < len(self.lists.chunks):
            now = needs.withColumn("kth", F.lit(LEAST).cast("long"))
            if found is not None:
                kth = found.groupBy("anchor_id", "key").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
                now = needs.join(kth, ["anchor_id", "key"], "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
            each = now.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("key", "low", "high", "kth"))).alias("need"))  # as many as an anchor has positives
            asks = anchors.join(each, "vec_id").select("vec_id", "label", "v", F.col("need.key").alias("keys"), F.col("need.low").alias("lows"), F.col("need.high").alias("highs"), F.col("need.kth").alias("kth"))
            asks = self.work.save(asks.mapInArrow(_visit(self.lists, first, to, same), ASKS), f"{self.name}-asks-{turn}")
            asked = [r["list"] for r in asks.select("list").distinct().collect()]  # at most CENTROIDS
            if not asked:
                break
            meet = self.rows.filter(F.col("list").isin(asked)).union(asks).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "side")
            more = meet.mapInArrow(_score(k, same), FOUND)
            more = more if found is None else more.union(found.drop("rank"))
            last, found = found, self.work.save(more.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), f"{self.name}-{turn}")
            self.work.drop(f"{self.name}-asks-{turn}", *([f"{self.name}-{turn - 1}"] if last is not None else []))
            first, to, turn = to, to * GROW, turn + 1
        return found if found is not None else anchors.sparkSession.createDataFrame([], f"{FOUND}, rank int")


def mine_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, n_lists: int | None = None, work: Workspace | None = None) -> DataFrame:
    """vectors, anchors (vec_id, label, v of integers) -> anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Positives of an anchor are its first other rows of the same label by inner product (ties: smaller vec_id); the
    negatives of each are the first rows of other labels whose score is low to high percent of the positive's.

    Defined cases: rows with a null id, label or vector, an empty vector or a null component take no part; of rows that
    share a vec_id the least (label, vector) counts; anchors are ids and take label and vector from `vectors`; vectors of
    different lengths never meet; an anchor without positives, or a positive without negatives, has no rows.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark, "negatives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull()))
    rows = work.save(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "rows")
    ids = anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = None
    for size, n in sorted(rows.groupBy(F.size("v")).count().collect()):
        own = rows.filter(F.size("v") == size)
        count = n_lists or max(1, min(CENTROIDS, -(-n // LIST)))
        want = min(SAMPLE, n, max(64 * count, 4096))
        drawn = own.withColumn("h", F.xxhash64("vec_id")).filter(F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, 1.2 * want / n) * (1 << 30)))
        sample = np.array([r.v for r in drawn.orderBy("h", "vec_id").limit(SAMPLE).collect()], np.float64)
        centroids = fit(sample if len(sample) else np.zeros((1, size)), count)
        postings = work.save(own.mapInArrow(_assign(centroids), "list int, far double, vec_id long, label long, v array<long>"), f"postings-{size}")
        of = {r["list"]: r for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("label").alias("a"), F.max("label").alias("b")).collect()}
        of = [of.get(k) for k in range(len(centroids))]
        lists = Lists(centroids, np.array([r.far if r else 0.0 for r in of]), np.array([-(-r.n // CHUNK) if r else 0 for r in of]), np.array([bool(r) and r.a == r.b for r in of]), np.array([r.a if r else 0 for r in of]))
        asking = own.join(ids, "vec_id")
        every = asking.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("key"), F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high"))
        near = _Search(postings, lists, work, f"positives-{size}").run(asking, every, positives, True)
        near = near.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
        rest = F.pmod("positive_score", F.lit(100))
        whole = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
        needs = near.select("anchor_id", "key", (low * whole + F.ceil(low * rest / 100)).cast("long").alias("low"), (high * whole + F.floor(high * rest / 100)).cast("long").alias("high"))
        far = _Search(postings, lists, work, f"negatives-{size}").run(asking, needs.filter("low <= high"), negatives, False)
        found = far.join(near, ["anchor_id", "key"]).select("anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def stepped(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding, label, ...) -> vec_id, label, v: components in steps of 1/256 (ends of a long at most); rows with a null or non-finite one go.

    Where vec_id is divisible by 7 the label moves on by one, modulo 10.
    """
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.filter("vec_id is not null and label is not null and embedding is not null")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(256 * x)).alias("v"))
