"""The best documents of many queries by BM25, without a row for every document that a query touches.

A query of common words touches most documents, so queries times documents is what a join by term hands on. Here the
documents fall into blocks of bounded size by their key. A block's postings of the queries' terms are written once; then
each block meets the queries, adds up their scores in arrays, and hands on the few that can still be among the best.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kelpline.functions.text import query_segments, segments, tokens
from kelpline.operators.fts import ITSELF, K1, B, query_terms
from kelpline.sources.store import saved

#: Bytes of text in a block; queries that meet a block at once.
BLOCK_BYTES, PART = 8 << 20, 4096


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _postings(key: list[str], schema: pa.Schema):
    """A block's rows (key..., length, words) and the terms asked for -> a row a term, and one for the block itself."""

    def of(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.take(pc.sort_indices(docs, sort_keys=[(k, "ascending") for k in [*key, "length"]]))
        block, length = docs["block"][0].as_py(), pc.fill_null(docs["length"], -1).to_numpy()
        # Rows of one key and length are one document to the postings, and rows of one key are one result.
        new_key = np.any([np.diff(_codes(docs[k]), prepend=-1) != 0 for k in key], axis=0)
        new_doc = new_key | (np.diff(length, prepend=-2) != 0)
        of_row, first = np.cumsum(new_doc) - 1, np.flatnonzero(new_doc)
        words = docs["words"].combine_chunks()
        terms = wanted["term"].combine_chunks()
        found = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
        at = np.repeat(of_row, np.maximum(length, 0))[found >= 0]
        pair, tf = np.unique(found[found >= 0].astype(np.int64) * len(first) + at, return_counts=True)
        there, start = np.unique(pair // len(first), return_index=True)
        keys = docs.select(key).take(pa.array(np.flatnonzero(new_key))).combine_chunks()
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
        n, ends = len(there), np.append(start, len(pair))
        rows = {"block": [block] * n, "term": terms.take(pa.array(there)), "at": lists(ends, pair % len(first)), "tf": lists(ends, tf)}
        own = {
            "block": [block], "term": [ITSELF], "length": [length[first]], "result": [(np.cumsum(new_key) - 1)[first]], "n_docs": [len(length)], "n_sized": [int((length >= 0).sum())], "n_words": [int(length[length >= 0].sum())],
            "keys": pa.ListArray.from_arrays(pa.array([0, keys.num_rows], pa.int32()), pa.StructArray.from_arrays([keys[k].combine_chunks() for k in key], names=key)),
        }
        full = lambda got, n: pa.table([pa.array(got[f.name]).cast(f.type) if f.name in got else pa.nulls(n, f.type) for f in schema], schema=schema)
        return pa.concat_tables([full(rows, n), full(own, 1)])

    return of


def first_of_each(column: pa.ChunkedArray) -> np.ndarray:
    """Where the runs of a sorted column begin."""
    return np.flatnonzero(np.diff(_codes(column), prepend=-1))


def firsts(at: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    """The n of `at` with the most points, those of equal points in their order."""
    if len(at) <= n:
        return at
    p = points[at]
    least = np.partition(p, len(p) - n)[len(p) - n]
    above = at[p > least]
    return np.append(above, at[p == least][: n - len(above)])


def _best(key: list[str], best: int, k1: float, b: float, schema: pa.Schema):
    """A block's postings and the queries' weighted terms -> the best of every query in the block."""

    def of(index: pa.Table, weights: pa.Table) -> pa.Table:
        index = index.combine_chunks()
        own = index.filter(pc.equal(index["term"], ITSELF))
        index = index.filter(pc.not_equal(index["term"], ITSELF))
        if not index.num_rows or not weights.num_rows:
            return schema.empty_table()
        length, result = (own[c].combine_chunks().flatten().to_numpy() for c in ("length", "result"))
        keys = own["keys"].combine_chunks().flatten()
        at, tf = (index[c].combine_chunks().flatten().to_numpy() for c in ("at", "tf"))
        ends = np.append(0, np.cumsum(pc.list_value_length(index["at"]).to_numpy()))
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / weights["avg_length"][0].as_py()))
        at, repeated = result[at], len(result) > len(keys)
        row = pc.index_in(weights["term"].combine_chunks(), value_set=index["term"].combine_chunks())
        weights = weights.append_column("row", row).filter(pc.is_valid(row)).sort_by([("query_id", "ascending"), ("term", "ascending")])
        if not weights.num_rows:
            return schema.empty_table()
        idf, n_terms, row = (weights[c].to_numpy() for c in ("idf", "n_terms", "row"))
        starts = first_of_each(weights["query_id"])
        score, matched = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        queries, found, points, hits = [], [], [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(row)), strict=True):
            score[:], matched[:] = 0, 0
            for i in range(lo, hi):
                span = slice(ends[row[i]], ends[row[i] + 1])
                if repeated:
                    np.add.at(score, at[span], idf[i] * weight[span])
                    np.add.at(matched, at[span], 1)
                else:
                    score[at[span]] += idf[i] * weight[span]
                    matched[at[span]] += 1
            rounded = np.floor(score * 1e6 + 0.5)
            whole = matched == n_terms[lo]
            # Results are numbered in the order of their keys.
            kept = np.concatenate([firsts(np.flatnonzero(w), rounded, best) for w in (whole, (matched > 0) & ~whole)])
            queries.append(np.full(len(kept), lo))
            found.append(kept)
            points.append(rounded[kept] / 1e6)
            hits.append(matched[kept])
        q, keys = weights.select(["query_id", "n_terms"]).take(pa.array(np.concatenate(queries))), keys.take(pa.array(np.concatenate(found)))
        out = {"query_id": q["query_id"], "n_terms": q["n_terms"], "score": np.concatenate(points), "matched": np.concatenate(hits)} | dict(zip(key, keys.flatten(), strict=True))
        column = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)
        return pa.table([column(out[f.name]).cast(f.type) for f in schema], schema=schema)

    return of


def bm25_best(docs: DataFrame, key: list[str], text: str, queries: DataFrame, best: int, k1: float = K1, b: float = B, unspaced: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None, whole: str | None = None) -> DataFrame:
    """The rows of `fts.bm25` (query_id, key..., score, matched, n_terms) that can be among a query's first `best` by score
    and then key, of those with all its terms or of the others: the first of each block, ties cut in the order of the keys.

    Where the rows are pieces of longer texts, docs may be those, with the first column of the key and their text in `whole`:
    cut(docs) makes the rows and keeps other columns. It works behind the shuffle, which so carries no row for each piece.
    """
    spark, words = docs.sparkSession, segments if unspaced else tokens
    q = query_terms(queries, query_segments if unspaced else tokens)
    size = docs.agg(F.sum(F.octet_length(whole or text).cast("long"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    blocks = spark.range(n).withColumnRenamed("id", "block")
    # Text goes through the shuffle, and is cut into words behind it.
    d = docs.withColumn("block", F.pmod(F.xxhash64(*(key[:1] if cut else key)), F.lit(n))).repartition("block")
    d = (cut(d) if cut else d).select("block", *key, words(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    kinds = StructType([d.schema[k] for k in key])
    columns = f"block long, term string, at array<int>, tf array<int>, length array<int>, result array<int>, n_docs long, n_sized long, n_words long, keys array<{kinds.simpleString()}>"
    shape = to_arrow_schema(StructType.fromDDL(columns))
    asked = blocks.crossJoin(q.select("term").distinct())
    index = saved(d.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_postings(key, shape), columns), "best-postings")

    total = index.filter(F.col("term") == ITSELF).agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_words") / F.sum("n_sized")).alias("avg_length"))
    df = index.filter(F.col("term") != ITSELF).groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = q.join(df, "term").join(F.broadcast(total)).select("query_id", "n_terms", "term", idf.alias("idf"), "avg_length")
    parts = -(-queries.count() // PART) or 1
    weights = saved(weights.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "best-weights")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    schema = StructType([q.schema["query_id"], *kinds, *StructType.fromDDL("score double, matched long"), q.schema["n_terms"]])
    pairs = index.groupBy("block", "part").cogroup(weights.crossJoin(blocks).groupBy("block", "part"))
    return pairs.applyInArrow(_best(key, best, k1, b, to_arrow_schema(schema)), schema)
