"""A saved full-text index in blocks, and exact best-k search that leaves out blocks which can't reach a result.

Documents are numbered by size, BLOCK of them form a block, and up to SHARD blocks, or WORDS words, a shard. An index row
is a term in a shard: the documents that have it and how often. A common term is as many rows as there are shards, so no task gets
it whole. In a shard, the highest weights of a query's terms in a block add up to a bound on every score in it. The blocks
with the best bounds are scored first; what the k-th document of all shards has then is the least that any other block must reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kelpline.functions.text import tokens
from kelpline.operators.best import PART, firsts, first_of_each
from kelpline.operators.fts import ITSELF, K1, B, query_terms
from kelpline.sources.store import saved

#: Documents of a block, blocks and words of a shard at most; blocks of a query in a shard that are scored before the others are judged.
BLOCK, SHARD, WORDS, FIRST = 16, 128, 1 << 20, 2
#: Rows of an Arrow batch at most, as batches hold whole texts.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


class BlockIndex(NamedTuple):
    """rows(shard, term, at, tf): postings by place in the shard; a row of term ITSELF a shard has the documents' length and keys."""

    rows: DataFrame
    key: list[str]
    kinds: StructType
    k1: float
    b: float


def _shards(key: list[str], schema: pa.Schema):
    """Batches of documents (doc, key..., words), numbered in order -> index rows."""

    def rows(docs: pa.Table) -> pa.Table:
        shard, n = docs["doc"][0].as_py(), docs.num_rows
        words = docs["words"].combine_chunks()
        length = pc.fill_null(pc.list_value_length(words), -1).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(codes * n + np.repeat(np.arange(n), np.maximum(length, 0)), return_counts=True)
        term, start = np.unique(pair // n, return_index=True)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(start, len(pair)), pa.int32()), pa.array(values, pa.int32()))
        place = np.empty(n, np.int64)
        place[pc.sort_indices(docs, sort_keys=[(k, "ascending") for k in key]).to_numpy()] = np.arange(n)
        keys = docs.select(key).combine_chunks()
        own = {
            "shard": [shard], "term": [ITSELF], "length": [length], "place": [place],
            "keys": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.StructArray.from_arrays([keys[k].combine_chunks() if isinstance(keys[k], pa.ChunkedArray) else keys[k] for k in key], names=key)),
        }
        full = lambda got, m: pa.table([pa.array(got[f.name]).cast(f.type) if f.name in got else pa.nulls(m, f.type) for f in schema], schema=schema)
        posts = {"shard": [shard] * len(term), "term": coded.dictionary.take(pa.array(term)), "at": lists(pair % n), "tf": lists(tf)}
        return pa.concat_tables([full(posts, len(term)), full(own, 1)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = words = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                # Numbers begin at a multiple of BLOCK in each partition; a batch need not.
                piece = batch.slice(lo, BLOCK)
                while piece.num_rows:
                    part = piece.slice(0, BLOCK - docs % BLOCK)
                    piece = piece.slice(part.num_rows)
                    held.append(part)
                    docs += part.num_rows
                    words += pc.sum(pc.list_value_length(part["words"])).as_py() or 0
                    if docs % BLOCK == 0 and (docs == BLOCK * SHARD or words >= WORDS):
                        yield from rows(pa.Table.from_batches(held)).to_batches()
                        held, docs, words = [], 0, 0
        if docs:
            yield from rows(pa.Table.from_batches(held)).to_batches()

    return of


def build(docs: DataFrame, key: list[str], text: str, k1: float = K1, b: float = B) -> BlockIndex:
    """docs(key..., text, ...) -> the index, written under the shared folder. A null text has no tokens and no length, an empty one 0."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, BATCH_ROWS)
    # Text goes through the shuffle, the only one, and is cut into words behind it.
    d = docs.select(*key, F.col(text).alias("text"), F.octet_length(text).alias("bytes")).repartitionByRange("bytes", *key).sortWithinPartitions("bytes", *key)
    d = d.select(F.monotonically_increasing_id().alias("doc"), *key, tokens(F.col("text")).alias("words"))
    kinds = StructType([d.schema[k] for k in key])
    columns = f"shard long, term string, at array<int>, tf array<int>, length array<int>, place array<int>, keys array<{kinds.simpleString()}>"
    rows = d.mapInArrow(_shards(key, to_arrow_schema(StructType.fromDDL(columns))), columns)
    return BlockIndex(saved(rows, "block-index"), key, kinds, k1, b)


def _search(key: list[str], k: int, k1: float, b: float, schema: pa.Schema, what: str):
    """A shard's rows and the queries' weighted terms -> by `what`: the best scores of the blocks that come first; the best
    of every query in the shard; or what was read of its blocks."""

    def of(rows: pa.Table, weights: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = rows.filter(pc.equal(rows["term"], ITSELF))
        rows = rows.filter(pc.not_equal(rows["term"], ITSELF))
        if not rows.num_rows or not weights.num_rows:
            return schema.empty_table()
        length, place = (own[c].combine_chunks().flatten().to_numpy() for c in ("length", "place"))
        keys, shard = own["keys"].combine_chunks().flatten(), own["shard"][0].as_py()
        at, tf = (rows[c].combine_chunks().flatten().to_numpy() for c in ("at", "tf"))
        ends = np.append(0, np.cumsum(pc.list_value_length(rows["at"]).to_numpy()))
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / weights["avg_length"][0].as_py()))
        # Spans of one term in one block, with the highest weight there.
        new = np.diff(at // BLOCK, prepend=-1) != 0
        new[ends[:-1]] = True
        span = np.append(np.flatnonzero(new), len(at))
        block, top = at[span[:-1]] // BLOCK, np.maximum.reduceat(weight, span[:-1])
        spans = np.searchsorted(span, ends)
        found = pc.index_in(weights["term"].combine_chunks(), value_set=rows["term"].combine_chunks())
        weights = weights.append_column("row", found).filter(pc.is_valid(found)).sort_by([("query_id", "ascending"), ("term", "ascending")])
        if not weights.num_rows:
            return schema.empty_table()
        idf, n_terms, row = (weights[c].to_numpy() for c in ("idf", "n_terms", "row"))
        any_leasts, all_leasts = (weights[c].to_numpy() for c in ("any_least", "all_least"))
        n_blocks, out, read = -(-len(length) // BLOCK), [], []
        score, matched = np.zeros(len(length)), np.zeros(len(length), np.int64)

        def add(lo: int, hi: int, chosen: np.ndarray) -> None:
            whole = chosen.all()
            for i in range(lo, hi):
                here = slice(spans[row[i]], spans[row[i] + 1])
                if whole:
                    p = slice(ends[row[i]], ends[row[i] + 1])
                else:
                    s = np.flatnonzero(chosen[block[here]]) + here.start
                    n = span[s + 1] - span[s]
                    p = np.repeat(span[s] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                score[at[p]] += idf[i] * weight[p]
                matched[at[p]] += 1

        starts = first_of_each(weights["query_id"])
        for lo, hi in zip(starts, np.append(starts[1:], len(row)), strict=True):
            score[:], matched[:] = 0, 0
            bound, present = np.zeros(n_blocks), np.zeros(n_blocks, np.int64)
            for i in range(lo, hi):
                here = slice(spans[row[i]], spans[row[i] + 1])
                bound[block[here]] += idf[i] * top[here]
                present[block[here]] += 1
            held = np.flatnonzero(present)
            order = held[np.argsort(-bound[held], kind="stable")]
            early = np.zeros(n_blocks, bool)
            early[order[: max(FIRST, -(-k // BLOCK))]] = True
            add(lo, hi, early)
            rounded = np.floor(score * 1e6 + 0.5)

            if what == "first":
                for strict, which in ((False, np.flatnonzero(matched)), (True, np.flatnonzero(matched == n_terms[lo]))):
                    best = firsts(which, rounded, k)
                    out.append((np.full(len(best), lo), rounded[best] / 1e6, np.full(len(best), strict)))
                continue
            any_least, all_least = any_leasts[lo], all_leasts[lo]
            kept = (present > 0) & ((bound + 1e-6 >= any_least) | ((present == n_terms[lo]) & (bound + 1e-6 >= all_least)))
            if what == "blocks":
                read.append(pa.table([pa.array(np.full(len(held), lo)), pa.array(held + shard // BLOCK), pa.array(bound[held]), pa.array((kept | early)[held])], names=["q", "block", "bound", "scored"]))
                continue
            add(lo, hi, kept & ~early)
            rounded = np.floor(score * 1e6 + 0.5)
            whole = matched == n_terms[lo]
            best = np.concatenate([firsts(np.flatnonzero(w)[np.argsort(place[np.flatnonzero(w)])], rounded, k) for w in (whole, (matched > 0) & ~whole)])
            out.append((np.full(len(best), lo), best, rounded[best] / 1e6, matched[best]))
        if what == "blocks":
            r = pa.concat_tables(read).combine_chunks()
            got = {"query_id": weights["query_id"].take(r["q"]), "block": r["block"], "bound": r["bound"], "scored": r["scored"]}
        elif what == "first":
            q, points, strict = (np.concatenate(x) for x in zip(*out, strict=True))
            got = {"query_id": weights["query_id"].take(pa.array(q)), "score": points, "strict": strict}
        else:
            q, best, points, hits = (np.concatenate(x) for x in zip(*out, strict=True))
            w, found_keys = weights.select(["query_id", "n_terms"]).take(pa.array(q)), keys.take(pa.array(best))
            got = {"query_id": w["query_id"], "n_terms": w["n_terms"], "score": points, "matched": hits} | dict(zip(key, found_keys.flatten(), strict=True))
        column = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)
        return pa.table([column(got[f.name]).cast(f.type) for f in schema], schema=schema)

    return of


def search(index: BlockIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(scores, blocks): scores(query_id, key..., score, matched, n_terms) hold the k best documents of each query and the k
    best of those with all its terms, ties cut in the order of the keys, and some others; blocks(query_id, block, bound,
    scored) what was read.
    """
    spark, q = queries.sparkSession, query_terms(queries)
    asked = q.select("term").distinct().union(spark.sql(f"SELECT '{ITSELF}' AS term"))
    rows = saved(index.rows.join(asked, "term", "left_semi").select(*index.rows.columns), "block-asked")
    own = rows.filter(F.col("term") == ITSELF)
    sized = F.filter("length", lambda x: x >= 0)
    total = own.agg(F.sum(F.size("length")).alias("n_docs"), (F.sum(F.aggregate(sized, F.lit(0).cast("long"), lambda a, x: a + x)) / F.sum(F.size(sized))).alias("avg_length"))
    df = rows.filter(F.col("term") != ITSELF).groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = q.join(df, "term").join(F.broadcast(total)).select("query_id", "n_terms", "term", idf.alias("idf"), "avg_length")
    parts = -(-queries.count() // PART) or 1
    weights = saved(weights.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "block-weights")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    shards = own.select((F.col("shard") + 0).alias("shard"))

    def run(w: DataFrame, what: str, schema: StructType) -> DataFrame:
        pairs = rows.groupBy("shard", "part").cogroup(w.crossJoin(shards).groupBy("shard", "part"))
        return pairs.applyInArrow(_search(index.key, k, index.k1, index.b, to_arrow_schema(schema), what), schema)

    none = F.lit(0.0)
    by_query = lambda columns: StructType([q.schema["query_id"], *StructType.fromDDL(columns)])
    first = run(weights.withColumns({"any_least": none, "all_least": none}), "first", by_query("score double, strict boolean"))
    kth = first.withColumn("p", F.row_number().over(Window.partitionBy("query_id", "strict").orderBy(F.desc("score")))).filter(F.col("p") == k)
    kth = saved(kth.groupBy("query_id").agg(F.max(F.when(~F.col("strict"), F.col("score"))).alias("any_least"), F.max(F.when(F.col("strict"), F.col("score"))).alias("all_least")), "block-least")
    weights = saved(weights.join(kth, "query_id", "left").fillna(0.0, ["any_least", "all_least"]), "block-judged")
    scores = StructType([q.schema["query_id"], *index.kinds, *StructType.fromDDL("score double, matched long"), q.schema["n_terms"]])
    return run(weights, "scores", scores), run(weights, "blocks", by_query("block long, bound double, scored boolean"))
