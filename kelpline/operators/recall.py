"""Graph recall: from the words of queries to symbols, to what is related to them, to files and to their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators.fusion import top_k
from kelpline.sources.store import saved

#: Scores of a symbol named in full and of one with the word in its name, and what a relation and a call pass on.
NAMED, WORDED, RELATED, CALLER = 1.0, 0.8, 0.75, 0.7


def matched_symbols(terms: DataFrame, symbols: DataFrame, top: int = 20) -> DataFrame:
    """terms(query_id, term), symbols(id, name, ...) -> (query_id, id, score): the best match of each symbol.

    By name, or by a word of the lower-cased name: the `top` shortest such names of each term, ties by id. A term that many
    queries hold is looked up once.
    """
    t = terms.select("query_id", "term").distinct()
    full = symbols.select("id", F.col("name").alias("term")).join(t, "term").select("query_id", "id", F.lit(NAMED).alias("score"))
    word = symbols.select("id", "name", F.explode(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}_]+"))).alias("term")).filter("term <> ''")
    asked = word.join(t.select("term").distinct(), "term", "left_semi")
    some = top_k(asked, ["term"], [F.length("name"), "id"], top).join(t, "term").select("query_id", "id", F.lit(WORDED).alias("score"))
    return full.union(some).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def related_symbols(matched: DataFrame, edges: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each way to a symbol: matched itself, by a relation either way, as the caller of a call to it.

    edges(from_id, to_id), calls(caller_id, target_id); -> (query_id, name, file_path, score).
    """
    known = symbols.select("id", "name", "file_path")
    both = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).union(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    by_edge = matched.join(both, "id").select("query_id", F.col("other").alias("id"), (F.col("score") * RELATED).alias("score"))
    by_call = matched.join(calls.select(F.col("target_id").alias("id"), "caller_id"), "id").select("query_id", F.col("caller_id").alias("id"), (F.col("score") * CALLER).alias("score"))
    return matched.union(by_edge).union(by_call).join(known, "id").select("query_id", "name", "file_path", "score")


def graph_chunks(related: DataFrame, chunks: DataFrame, per_file: int = 3) -> DataFrame:
    """related, chunks(file_path, chunk_index, breadcrumb, code) -> (query_id, file_path, chunk_index, score, named, rank).

    A file has the best score of its symbols; its chunks are the first `per_file` by how many of the ways end in a name that
    the chunk holds (case aside), those of none left out. rank, zero-based, is by score, file and chunk.
    """
    # Files, pairs and what chunks name all start from the names: the ways to symbols are joined once.
    names = saved(related.groupBy("query_id", "file_path", F.lower("name").alias("name")).agg(F.count("*").alias("ways"), F.max("score").alias("best")), "graph-names")
    files = names.groupBy("query_id", "file_path").agg(F.max("best").alias("score"))
    text = F.lower(F.concat_ws("\n", F.coalesce("breadcrumb", F.lit("")), F.coalesce("code", F.lit(""))))
    # Which names a chunk holds doesn't depend on the query: each pair of a file is tried once.
    pairs = names.select("file_path", "name").distinct().join(chunks.select("file_path", "chunk_index", text.alias("text")), "file_path").filter(F.contains("text", "name")).select("file_path", "name", "chunk_index")
    named = names.join(pairs, ["file_path", "name"]).groupBy("query_id", "file_path", "chunk_index").agg(F.sum("ways").alias("named"))
    best = top_k(named, ["query_id", "file_path"], [F.col("named").desc(), "chunk_index"], per_file, "place").join(files, ["query_id", "file_path"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file_path", "place")
    return best.select("query_id", "file_path", "chunk_index", F.round("score", 6).alias("score"), "named", (F.row_number().over(order) - 1).alias("rank"))


def graph_recall(terms: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame, chunks: DataFrame, top: int = 20, per_file: int = 3) -> DataFrame:
    """The whole way from terms to chunks; null terms, names and ends find nothing."""
    matched = saved(matched_symbols(terms, symbols, top), "graph-matched")
    return graph_chunks(related_symbols(matched, edges, calls, symbols), chunks, per_file)
