"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of distinct five-word shingles. Copies of a set collapse into one node first. Banded min-hashes
propose candidates; their signatures are compared in batches, and a pair is pruned as soon as the posterior
probability of reaching the threshold falls under a chosen miss probability (BayesLSH). Survivors are confirmed on
the full sets, so no link is approximate; only banding and pruning can miss one, with the probabilities below.

Banding: 32 bands of 4 rows propose a pair of similarity 0.75 with probability 1 - (1 - 0.75^4)^32 > 1 - 6e-6.

Groups stay linear. Each bucket first links its members to its least node (a star). After those links have been
confirmed and merged into components, only buckets that still hold several components are searched: members outside
the component of the bucket's least node meet all members of other components, in parts of bounded size, which prune and
confirm in place and give a link for two components at most once. No member of a bucket is dropped or capped, and
members of one component never meet again.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.components import connected_components
from kelpline.llm.store import Workspace, tidy
from kelpline.llm.words import SHINGLE, blocks, mix, shingle_sets

BANDS, ROWS = 32, 4
#: Min-hashes that are banded, and those whose low bytes the signature keeps (the banded ones first).
HASHES, SIGNED_HASHES = BANDS * ROWS, 384
#: Hash comparisons per verification batch, and the posterior probability under which a pair is given up.
BATCH, MISS = 16, 1e-6
#: Expected bytes of either side of a bucket part in the search between components. Its first look is at rows with SHORT
#: hashes and the low 4 bytes of each band key; only rows that have a partner left go on to one at whole rows.
PART_BYTES, SHORT = 4 << 20, 128

_SEEDS = mix(np.arange(1, 2 * SIGNED_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:SIGNED_HASHES], _SEEDS[SIGNED_HASHES:] | np.uint64(1)
_BAND = np.array([mix(np.array([b + 1], np.uint64))[0] for b in range(BANDS)], np.uint64)

SIGNED = "doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>, low binary"


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Low bytes of the min-hashes (n x SIGNED_HASHES) and the band keys (n x BANDS) of nonempty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    mins = np.empty((len(sets), SIGNED_HASHES), np.uint64)
    for k in range(SIGNED_HASHES):
        mins[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
    mins = mix(mins)
    rows = mins[:, :HASHES].reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(_BAND, rows.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return (mins & np.uint64(255)).astype(np.uint8), keys.view(np.int64)


def _name(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(shingle: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = shingle_sets(texts, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, bands, low = ([None] * len(ids) for _ in range(3))
                if full:
                    signed, keys = signatures([sets[i] for i in full])
                    for j, i in enumerate(full):
                        sig[i], bands[i], low[i] = signed[j].tobytes(), keys[j], keys[j].astype(np.int32).tobytes()
                yield pa.record_batch(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_name(s) for s in sets], pa.binary()),
                        pa.array(sig, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(low, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "sig", "bands", "low"],
                )

    return run


def bounds(threshold: float, batch: int = BATCH, miss: float = MISS, hashes: int = SIGNED_HASHES) -> list[tuple[int, int]]:
    """(compared, least agreements): with fewer, P(similarity >= threshold | agreements) < miss under a uniform prior.

    Only low bytes are kept, so unequal hashes agree once in 256: a similarity s shows as s + (1 - s) / 256.
    """
    grid = (np.arange(20000) + 0.5) / 20000
    shown = grid + (1 - grid) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(shown) + (n - m) * np.log1p(-shown)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                out.append((n, m))
                break
    return out


def survive(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch prunes."""
    live = np.arange(len(a))
    agree = np.zeros(len(a), np.int32)
    at = 0
    for n, least in limits:
        agree = agree + (a[live, at:n] == b[live, at:n]).sum(axis=1)
        keep = agree >= least
        live, agree, at = live[keep], agree[keep], n
        if not len(live):
            break
    return live


def _matrix(column: pa.Array, width: int = SIGNED_HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _prune(limits):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = survive(_matrix(batch.column(2)), _matrix(batch.column(3)), limits)
                yield batch.select([0, 1]).take(pa.array(live, pa.int64()))

    return run


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets of which one is not empty."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int, shingle: int):
    """Rows (a, b, text_a, text_b) -> (a, b) with 100 * intersection >= percent * union on full sets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(text: bytes) -> np.ndarray:
            if text in known:
                known.move_to_end(text)
            else:
                known[text] = shingle_sets([text], shingle)[0]
                if len(known) > 64:
                    known.popitem(last=False)
            return known[text]

        for batch in batches:
            a, b = [], []
            for i, j, s, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if alike(of(s), of(t), percent):
                    a.append(i)
                    b.append(j)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig, bands, set_id, text, shingle) -> (node, sig, bands, set) of the text that has the set: its sorted shingles as bytes."""
    for batch in batches:
        sizes = batch.column(5).to_pylist()
        sets = shingle_sets(batch.column(4).to_pylist(), sizes[0]) if sizes else []
        own = [i for i, (s, name) in enumerate(zip(sets, batch.column(3).to_pylist(), strict=True)) if _name(s) == name]
        kept = batch.select([0, 1, 2]).take(pa.array(own, pa.int64()))
        yield pa.record_batch([*kept.columns, pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "sig", "bands", "set"])


def _parts(batches: Iterator[pa.RecordBatch], convert) -> Iterator[tuple[int, list[np.ndarray]] | None]:
    """Rows sorted by (key, block, chunk) -> (key, columns after these) of each part; None at the end of a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + convert(batch.columns[3:])
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield cols[0][a], [c[a:b] for c in cols[3:]]
        held = [c[cuts[-1] :] for c in cols]
        yield None
    if held is not None:
        yield held[0][0], held[3:]


def _partners(key, side, nodes, parts, outside, sig, bands, limits) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows that it meets and no look prunes) of a part.

    Rows of side 0 (outside the component of the bucket's least node) meet rows of side 1 (any); of two rows that
    are both outside, the lesser node asks. A pair that shares several buckets is compared in that of its first band.
    """
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        with_ = right[(parts[right] != parts[i]) & ((outside[right] == 0) | (nodes[right] > nodes[i]))]
        if len(with_):
            with_ = with_[bands[i][(bands[with_] == bands[i]).argmax(axis=1)] == key]
        if len(with_):
            with_ = with_[survive(np.broadcast_to(sig[i], (len(with_), sig.shape[1])), sig[with_], limits)]
        if len(with_):
            yield i, with_


def _glance(limits):
    """Parts of rows with short signatures -> (key, node) of the rows that some partner is left of."""
    limits = [x for x in limits if x[0] <= SHORT]

    def convert(cols: list[pa.Array]) -> list[np.ndarray]:
        kept = [c.to_numpy(zero_copy_only=False) for c in cols[:4]]
        return [*kept, _matrix(cols[4], SHORT), np.frombuffer(b"".join(cols[5].to_pylist()), np.int32).reshape(-1, BANDS)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part in _parts(batches, convert):
            if part is None:
                yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["key", "node"])
                out = []
                continue
            key, cols = part
            near = {int(x) for i, with_ in _partners(np.array([key], np.int64).view(np.int32)[0], *cols, limits) for x in cols[1][np.append(with_, i)]}
            out += [(key, x) for x in near]
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["key", "node"])

    return run


def _search(limits, percent: int):
    """Parts of rows with whole signatures and sets -> confirmed links of different components.

    What survives pruning is compared on the full sets here, and components that a link joins do not meet again in the
    part, so a part gives fewer links than it has components.
    """

    def convert(cols: list[pa.Array]) -> list[np.ndarray]:
        kept = [c.to_numpy(zero_copy_only=False) for c in cols[:4]]
        return [*kept, _matrix(cols[4]), cols[5].flatten().to_numpy().reshape(-1, BANDS), cols[6].to_numpy(zero_copy_only=False)]

    def links(key, side, nodes, parts, outside, sig, bands, sets) -> list[tuple[int, int]]:
        joined = {int(p): int(p) for p in np.unique(parts)}
        full = [np.frombuffer(x, np.uint64) for x in sets]

        def find(p: int) -> int:
            while joined[p] != p:
                joined[p] = joined[joined[p]]
                p = joined[p]
            return p

        out = []
        for i, with_ in _partners(key, side, nodes, parts, outside, sig, bands, limits):
            for j in with_[np.argsort(-(sig[with_] == sig[i]).sum(axis=1), kind="stable")].tolist():
                p, q = find(int(parts[i])), find(int(parts[j]))
                if p != q and alike(full[i], full[j], percent):
                    joined[q] = p
                    out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, convert):
            out = links(part[0], *part[1]) if part else []
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """rows(key, node, outside, bytes, ...) -> parts of buckets: every row outside meets all rows of its bucket, in parts of bounded size."""
    size = rows.groupBy("key").agg(F.sum("bytes").alias("all"), F.sum(F.col("outside") * F.col("bytes")).alias("asking"))
    rows = rows.join(size, "key")
    chunks, blocks_ = (F.greatest(F.lit(1), F.ceil(F.col(c) / PART_BYTES)).cast("int") for c in ("all", "asking"))
    place = F.xxhash64("node", F.lit(1))
    asks = rows.filter("outside = 1").withColumn("block", F.pmod(place, blocks_).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    asked = rows.withColumn("chunk", F.pmod(place, chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks_ - 1)))
    asks, asked = (x.select("key", "block", "chunk", F.lit(side).alias("side"), "node", "part", "outside", *columns) for side, x in enumerate((asks, asked)))
    return asks.union(asked).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")


def near_duplicates(docs: DataFrame, threshold_percent: int = 75, shingle: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """Near-duplicate classes of `docs(doc_id, text, ...)`; one row per row of docs.

    Returns doc_id, n_shingles (set size), component_id (least doc_id reachable over links, itself included),
    kept (doc_id = component_id) and n_links (confirmed links that the search used for the document's set).

    Defined cases: a null or blank text is an empty set and linked with nothing; rows that share a doc_id count as
    versions of one document and share a component; a null doc_id cannot be named, so such a row is linked with
    nothing, has a null component_id and is kept. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    limits = bounds(threshold_percent / 100, miss=miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = work.save(texts.mapInArrow(_sign(shingle), SIGNED), "signed")

    named = signed.filter("doc_id is not null and n_shingles > 0")
    nodes = named.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    nodes = work.save(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    stars = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    members = work.save(banded.join(stars.select("key", "least"), "key"), "members")

    candidates = members.select("node").distinct()
    signs = nodes.select("node", "sig", "bands", "low", "set_id").join(candidates, "node", "left_semi")
    held = work.save(signs.join(texts.withColumnRenamed("doc_id", "node"), "node"), "candidates")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (held.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_prune(limits), "a long, b long")
        pairs = work.save(pairs, f"{name}-survivors")  # one Python worker a task at a time
        a, b = (held.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        rows = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return work.save(rows.mapInArrow(_confirm(threshold_percent, shingle), "a long, b long"), name)

    starred = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(starred, "star-links")
    parts = connected_components(links, work, "parts")

    labelled = members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    open_ = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min_by("part", "node").alias("home")).filter("p < q")
    rows = labelled.join(open_.select("key", "home"), "key").select("key", "node", "part", (F.col("part") != F.col("home")).cast("int").alias("outside"))
    rows = work.save(rows, "open")
    work.drop("candidates")
    short = signs.select("node", F.substring("sig", 1, SHORT).alias("short"), F.col("low").alias("low"))
    first = _dealt(rows.withColumn("bytes", F.lit(SHORT + 4 * BANDS)).join(short, "node"), "short", "low")
    near = work.save(first.mapInArrow(_glance(limits), "key long, node long").distinct(), "near")
    sets = signs.join(near.select("node").distinct(), "node", "left_semi").join(texts.withColumnRenamed("doc_id", "node"), "node")
    sets = work.save(sets.select("node", "sig", "bands", "set_id", "text", F.lit(shingle)).mapInArrow(_sets, "node long, sig binary, bands array<long>, set binary").dropDuplicates(["node", "set"]), "sets")
    second = rows.join(near, ["key", "node"], "left_semi").join(sets, "node").withColumn("bytes", F.length("set") + SIGNED_HASHES + 8 * BANDS)
    more = work.save(_dealt(second, "sig", "bands", "set").mapInArrow(_search(limits, threshold_percent), "a long, b long").distinct(), "cross-links")
    work.drop("members", "open", "near", "sets")
    links = links.union(more).distinct()
    parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), work, "all")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = nodes.select("set_id", "node").join(parts, "node", "left").join(degree, "node", "left")
    known = known.select("set_id", F.coalesce("component", "node").alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
