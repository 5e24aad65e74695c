"""Text around a hit: scans without an index with their snippets, and the text that a reranker reads."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kelpline.functions.text import tokens
from kelpline.operators.best import BLOCK_BYTES
from kelpline.operators.fusion import top_k
from kelpline.sources.store import saved

#: Points for a technical term and for a query term, in the path and in the text.
PATH_POINTS, TEXT_POINTS = (10, 3), (20, 5)
BEFORE, AFTER = 3, 4


def _terms_in(terms: list[str]):
    """text -> the numbers of the terms that it holds. A term of word characters lies within a run of them, so each run is looked through once."""
    number, odd = {}, {}
    for k, term in enumerate(terms):
        if mark := re.search(r"\W", term):
            odd.setdefault(mark[0], []).append((term, k))
        else:
            number[term] = k
    lengths, known, runs = sorted({len(x) for x in number}), {}, re.compile(r"\w+")

    def inside(run: str) -> set[int]:
        return {number[x] for size in lengths if size <= len(run) for i in range(len(run) - size + 1) if (x := run[i : i + size]) in number}

    def of(text: str | None) -> set[int]:
        found: set[int] = set()
        for run in set(runs.findall(text or "")):
            if (there := known.get(run)) is None:
                there = inside(run)
                if len(run) <= 64:
                    known[run] = there
            found |= there
        return found | {k for mark, some in odd.items() if mark in (text or "") for term, k in some if term in text}

    return of


def _scan(limit: int, schema: pa.Schema):
    """A block's files (path, low, text) and the terms of all queries -> each query's first `limit` files there by score and path."""

    def of(files: pa.Table, asked: pa.Table) -> pa.Table:
        if not files.num_rows or not asked.num_rows:
            return schema.empty_table()
        files, asked = files.take(pc.sort_indices(files, sort_keys=[("path", "ascending")])), asked.sort_by("query_id")
        terms = pc.unique(asked["term"])
        held, hits = _terms_in(terms.to_pylist()), ([[] for _ in terms], [[] for _ in terms])
        code = files["path"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.diff(code, prepend=-1) != 0
        for i, low, text in zip(np.cumsum(first) - 1, files["low"], files["text"], strict=True):
            for side, value in zip(hits, (low, text), strict=True):
                for k in held(value.as_py()):
                    side[k].append(i)
        hits = [[np.array(x, np.int64) for x in side] for side in hits]
        paths, term, technical = files["path"].combine_chunks().take(pa.array(np.flatnonzero(first))), pc.index_in(asked["term"], value_set=terms).to_numpy(), asked["technical"].to_pylist()
        query = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        score, of_query, found, points = np.zeros(len(paths), np.int64), [], [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(query)), strict=True):
            score[:] = 0
            for i in range(lo, hi):
                for side, worth in zip(hits, (PATH_POINTS, TEXT_POINTS), strict=True):
                    np.add.at(score, side[term[i]], worth[not technical[i]])
            best = np.argsort(-score, kind="stable")[:limit]  # paths are in order
            best = best[score[best] > 0]
            of_query.append(np.full(len(best), lo))
            found.append(best)
            points.append(score[best])
        rows = [asked["query_id"].combine_chunks().take(pa.array(np.concatenate(of_query))), paths.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(points))]
        return pa.table([c.cast(f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return of


def cold_start(files: DataFrame, terms: DataFrame, limit: int = 5, most_bytes: int = 262144) -> DataFrame:
    """files(path, size, content), terms(query_id, n, term, technical) -> the best files of each query with a snippet.

    Terms may lie anywhere in the lower-cased path or text. The snippet's place is the start of the file where the first
    term found (technical ones first, then by n) lies in the path, else the earliest place of any term in the text; it
    shows three lines before and four after. Equal scores go by path. Files above most_bytes are left out.

    Files fall into blocks of bounded size; each meets the terms, and only the first `limit` files of a query in a block
    go on. What a snippet needs is looked up in the best files alone.
    """
    t = terms.filter("term <> ''").select("query_id", "n", F.lower("term").alias("term"), "technical").distinct()
    small = files.filter(F.col("size") <= most_bytes)
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-(small.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES))
    blocks = files.sparkSession.range(n).withColumnRenamed("id", "block")
    kinds = StructType([t.schema["query_id"], *StructType.fromDDL("path string, score long")])
    seen = small.select(F.pmod(F.xxhash64("path"), F.lit(n)).alias("block"), "path", "content").repartition("block").select("block", "path", F.lower("path").alias("low"), F.lower("content").alias("text"))
    few = seen.groupBy("block").cogroup(t.crossJoin(blocks).groupBy("block")).applyInArrow(_scan(limit, to_arrow_schema(kinds)), kinds)
    best = saved(top_k(few, ["query_id"], [F.col("score").desc(), F.col("path").asc_nulls_last()], limit), "scan-best")

    asked = t.groupBy("query_id").agg(F.collect_list(F.struct("n", "term", "technical")).alias("asked"))
    at = best.join(small.select("path", F.lower("path").alias("low"), F.lower("content").alias("text")), "path").join(asked, "query_id")
    hit = lambda x: F.struct((~x["technical"]).alias("late"), x["n"].alias("n"), x["term"].alias("term"), F.coalesce(F.contains("low", x["term"]), F.lit(False)).alias("in_path"), F.coalesce(F.call_function("instr", F.col("text"), x["term"]), F.lit(0)).alias("at"))
    at = at.select("query_id", "path", "rank", "score", F.filter(F.transform("asked", hit), lambda h: h["in_path"] | (h["at"] > 0)).alias("hits"))
    order = F.array_min(F.transform("hits", lambda h: F.struct(h["late"].alias("late"), h["n"].alias("n"), h["term"].alias("term"), h["in_path"].alias("in_path"))))
    place = F.array_min(F.transform(F.filter("hits", lambda h: h["at"] > 0), lambda h: F.struct(h["at"].alias("at"), h["late"].alias("late"), h["n"].alias("n"), h["term"].alias("term"))))
    g = at.groupBy("query_id", "path", "rank", "score").agg(F.min(order).alias("first"), F.min(place).alias("earliest"))
    lead = F.col("first.in_path")
    best = g.select("query_id", "path", "rank", "score", F.when(lead, 0).otherwise(F.col("earliest.at") - 1).alias("offset"), F.when(lead, F.col("first.term")).otherwise(F.col("earliest.term")).alias("token"))
    lines = F.split("content", "\n")
    before = F.substr("content", F.lit(1), F.col("offset"))
    r = best.join(small.select("path", "content"), "path").withColumn("line", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))
    start, end = F.greatest(F.col("line") - BEFORE, F.lit(0)) + 1, F.least(F.col("line") + AFTER, F.size(lines) - 1) + 1
    return r.select("query_id", "path", "rank", "score", "token", start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("text"))


def rerank_text(hits: DataFrame, key: list[str], queries: DataFrame, crumb_chars: int = 250, chars: int = 1000, share: float = 0.67) -> DataFrame:
    """hits(query_id, key..., breadcrumb, code) -> (query_id, key..., text): breadcrumb, line break, code in `chars` characters.

    Longer code shows whole lines around its first line with most words of the query; lines above and below are taken in
    turn, and once one side has no line that fits, the other goes on alone. How far that is follows from running sums of
    line lengths: the rounds in which both sides fit, then what the one or the other side adds. Code without a word of the
    query shows its head and tail. Line breaks count; ellipses, put where lines are missing, don't.

    hits are distinct by (query_id, key...), and none of these is null.
    """
    words = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("words"))
    crumb, half = F.coalesce("breadcrumb", F.lit("")), (crumb_chars - 3) // 2
    head = F.when(F.length(crumb) <= crumb_chars, crumb).otherwise(F.concat(F.substring(crumb, 1, half), F.lit("..."), F.right(crumb, F.lit(half))))
    r = hits.join(words, "query_id").select(F.struct("query_id", *key).alias("of"), head.alias("head"), F.coalesce("code", F.lit("")).alias("code"), "words")
    r = r.withColumn("room", F.greatest(chars - F.length("head") - 1, F.lit(0)))
    lines = r.filter(F.length("code") > F.col("room")).select("of", "room", "words", F.posexplode(F.split("code", "\n")).alias("n", "line"))
    score = F.size(F.filter("words", lambda w: F.contains(F.lower("line"), w)))
    own, upto = Window.partitionBy("of"), Window.partitionBy("of").orderBy("n")
    lines = lines.select("of", "n", "room", (F.length("line") + 1).alias("size"), score.alias("score"))
    lines = lines.withColumn("sum", F.sum("size").over(upto)).withColumn("best", F.max(F.struct("score", (-F.col("n")).alias("n"))).over(own))
    lines = lines.filter("best.score > 0").withColumn("hit", -F.col("best.n"))
    at_hit = lambda c: F.max(F.when(F.col("n") == F.col("hit"), F.col(c))).over(own)
    lines = lines.withColumn("hit_sum", at_hit("sum")).withColumn("hit_size", at_hit("size"))
    up = F.max(F.when(F.col("n") <= F.col("hit"), F.col("hit_sum") - F.col("hit_size") - F.col("sum") + F.col("size") * (F.col("n") < F.col("hit")).cast("int") + F.col("hit_size") * (F.col("n") == F.col("hit")).cast("int")))
    down = F.max(F.when(F.col("n") >= F.col("hit"), F.col("sum") - F.col("hit_sum")))
    far = lines.groupBy("of", "hit", (F.col("room") - F.col("hit_size") + 1).alias("room"), F.abs(F.col("n") - F.col("hit")).alias("k")).agg(up.alias("up"), down.alias("down"))
    most = lambda fits: F.coalesce(F.max(F.when(fits, F.col("k"))).over(own), F.lit(0))
    far = far.withColumn("both", most(F.col("up") + F.col("down") <= F.col("room")))
    at_both = lambda c: F.max(F.when(F.col("k") == F.col("both"), F.col(c))).over(own)
    far = far.withColumn("up_both", at_both("up")).withColumn("down_both", at_both("down"))
    far = far.withColumn("above", most(F.col("up") + F.col("down_both") <= F.col("room"))).withColumn("below", most(F.col("up_both") + F.col("down") <= F.col("room")))
    above = F.greatest("above", "both")
    below = F.when(above > F.col("both"), F.col("both")).otherwise(F.greatest("below", "both"))
    shown = far.filter("k = 0").select("of", (F.col("hit") - above).alias("first"), (F.col("hit") + below).alias("last"))
    cut = F.split("code", "\n")
    around = F.concat(F.when(F.col("first") > 0, "...").otherwise(""), F.array_join(F.slice(cut, F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n"), F.when(F.col("last") < F.size(cut) - 1, "...").otherwise(""))
    front = F.floor(F.col("room") * share).cast("int")
    tail = F.col("room") - front - 3
    ends = F.when(tail > 0, F.concat(F.substr("code", F.lit(1), front), F.lit("..."), F.right("code", tail))).otherwise(F.substr("code", F.lit(1), F.col("room")))
    text = F.when(F.length("code") <= F.col("room"), F.col("code")).when(F.col("first").isNotNull(), around).otherwise(ends)
    return r.join(shown, "of", "left").select("of.*", F.concat("head", F.lit("\n"), text).alias("text"))
