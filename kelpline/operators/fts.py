"""Full-text search over postings: BM25 with strict-then-relaxed retrieval, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import query_segments, segments, tokens
from kelpline.sources.store import saved

K1, B = 1.2, 0.75


#: Stands for a document itself among its terms; no token is empty.
ITSELF = ""


def postings(docs: DataFrame, key: list[str], text: str, terms: DataFrame | None = None, itself: bool = False, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """docs -> (key..., length, term, tf); of the given terms alone if there are any; with a row (ITSELF) a document if asked for.

    length counts all tokens of the document, as `words` cuts it. Other terms go before anything is counted. explode_outer keeps Spark from
    adding a filter on the exploded array, which would tokenize every text once more.
    """
    t = docs.select(*key, words(F.col(text)).alias("terms"))
    own = F.array_append(F.coalesce("terms", F.array().cast("array<string>")), F.lit(ITSELF)) if itself else F.col("terms")
    flat = t.select(*key, F.size("terms").alias("length"), F.explode_outer(own).alias("term")).filter("term is not null")
    if terms is not None:
        flat = flat.join(terms.union(terms.sparkSession.sql(f"SELECT '{ITSELF}' AS term")) if itself else terms, "term", "left_semi")
    return flat.groupBy(*key, "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query_id, query) -> (query_id, n_terms, term), terms distinct."""
    t = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("terms"))
    return t.select("query_id", F.size("terms").alias("n_terms"), F.explode_outer("terms").alias("term")).filter("term is not null")


def bm25(docs: DataFrame, key: list[str], text: str, queries: DataFrame, k1: float = K1, b: float = B, unspaced: bool = False) -> DataFrame:
    """-> (query_id, key..., score, matched, n_terms) for every document with at least one query term.

    Texts are read once: the postings of the terms that some query holds are saved, with a row for each document itself,
    which gives the number and the average length of all and takes no part in the join by term. Those are one row and ride
    along as a broadcast; the terms' weights are as many as the queries' terms, and Spark's size check says how they join.
    unspaced looks into runs of Han and kana, by their characters in twos.
    """
    q = query_terms(queries, query_segments if unspaced else tokens)
    rows = saved(postings(docs, key, text, q.select("term").distinct(), itself=True, words=segments if unspaced else tokens), "postings")
    own = rows.filter(F.col("term") == ITSELF)
    stats = own.agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("length")) / F.sum(F.when(F.col("length").isNotNull(), F.col("tf")))).alias("avg_length"))
    used = rows.filter(F.col("term") != ITSELF)
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighted = q.join(df, "term").join(F.broadcast(stats)).select("query_id", "n_terms", "term", idf.alias("idf"), "avg_length")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    hits = used.join(weighted, "term")
    return hits.groupBy("query_id", *key, "n_terms").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def two_phase(scored: DataFrame, key: list[str], limit: int) -> DataFrame:
    """All-terms matches first, up to limit; any-term matches fill what is missing; the whole is ranked by score.

    The relaxed fetch takes the missing number and ten more and skips those already there. rank is zero-based.

    What either fetch can take is among the first limit + 10 strict and as many other matches of a query, which each
    task finds of its own rows before the shuffle (a window group limit); all the rest works on those few.
    """
    order = [F.col("score").desc(), *[F.col(k).asc_nulls_last() for k in key]]
    w = Window.partitionBy("query_id")
    strict = F.col("matched") == F.col("n_terms")
    own = F.row_number().over(Window.partitionBy("query_id", "strict").orderBy(*order))
    r = scored.withColumn("strict", strict).withColumn("own_rank", own).filter(F.col("own_rank") <= limit + 10)
    r = r.withColumn("any_rank", F.row_number().over(w.orderBy(*order)))
    r = r.withColumn("taken", F.col("strict") & (F.col("own_rank") <= limit))
    r = r.withColumn("n_strict", F.sum(F.col("taken").cast("int")).over(w))
    spare = ~F.col("taken") & (F.col("any_rank") <= limit - F.col("n_strict") + 10) & (F.col("n_terms") > 1)
    r = r.withColumn("spare_rank", F.when(spare, F.row_number().over(Window.partitionBy("query_id", spare).orderBy(*order))))
    kept = r.filter(F.col("taken") | (F.col("spare_rank") <= limit - F.col("n_strict")))
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return kept.select("query_id", *key, "score", F.when(F.col("taken"), "strict").otherwise("relaxed").alias("phase"), rank.alias("rank"))
