"""Skeletons of files and symbols: what a file imports, exports, declares and calls, as text to search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import bound, path_tokens, tokens
from kelpline.operators.best import bm25_best
from kelpline.operators.fusion import top_k

# A hint on a file's role, and what its lower-cased path, its lower-cased text or a symbol's name must match.
PATH_HINTS = [
    ("entrypoint", r"/index\.(?:ts|tsx|js|jsx|mts|mjs|cts|cjs)$"),
    ("cli", "/cli/"),
    ("mcp", "/mcp/"),
    ("command registration", "registercommands"),
    ("command handler", "/commands/"),
]
TEXT_HINTS = [
    ("command registration", "registerclicommands"),
    ("cli startup", r"cli\.parse"),
    ("mcp mode", r"ismcpmode|process\.argv\.push\('mcp'\)"),
    ("tool handler", "handlecodebaseretrieval"),
    ("adapter layer", "executeretrieval"),
]
NAME_HINTS = [("core service", "(?i)(?:service|store)$")]

#: A keyword, or a `from` with its quoted source.
_KEYWORD_OR_FROM = r"""import|export|from\s+['"]([^'"]+)['"]"""


def sources_of(text):
    """Sources of the imports and re-exports of a text, in order: each `from` whose nearest mark before is a keyword.

    One pass over the text finds keywords (empty here) and sources, however far apart they stand.
    """
    marks = F.regexp_extract_all(text, F.lit(_KEYWORD_OR_FROM), F.lit(1))
    return bound(marks, lambda m: F.filter(F.transform(m, lambda x, i: F.when((x != "") & (F.get(m, i - 1) == ""), F.trim(x)).otherwise("")), lambda x: x != ""))


def _hints(value, table):
    return [F.when(F.regexp_like(value, F.lit(pattern)), F.lit(hint)) for hint, pattern in table]


def file_skeletons(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """files(path, content), symbols(file_path, name, type, exported, parent_id), imports(file_path, source),
    calls(file_path, callee) -> (path, imports, exports, top_symbols, call_names, path_tokens, role_hints, summary).

    Names are sorted; imports, calls, tokens and hints are distinct. A file without any symbol keeps what its text and
    path say. Lists are as long as one file's symbols.
    """
    none = F.array().cast("array<string>")
    named = F.greatest(*[F.max(F.regexp_like("name", F.lit(p)).cast("int")) for _, p in NAME_HINTS], F.lit(0))
    s = symbols.groupBy(F.col("file_path").alias("path")).agg(
        F.array_sort(F.collect_list(F.when(F.col("exported"), F.col("name")))).alias("exports"),
        F.array_sort(F.collect_list(F.when(F.col("parent_id").isNull(), F.concat_ws(" ", "type", "name")))).alias("top_symbols"),
        named.alias("named"),
    )
    i = imports.groupBy(F.col("file_path").alias("path")).agg(F.collect_set(F.nullif(F.trim("source"), F.lit(""))).alias("stated"))
    c = calls.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_set("callee")).alias("call_names"))
    text = F.coalesce("content", F.lit(""))
    hints = _hints(F.lower("path"), PATH_HINTS) + _hints(F.lower(text), TEXT_HINTS) + [F.when(F.col("named") == 1, F.lit(hint)) for hint, _ in NAME_HINTS]
    r = files.select("path", "content").join(s, "path", "left").join(i, "path", "left").join(c, "path", "left")
    r = r.select(
        "path", F.array_sort(F.array_union(sources_of(text), F.coalesce("stated", none))).alias("imports"), F.coalesce("exports", none).alias("exports"), F.coalesce("top_symbols", none).alias("top_symbols"),
        F.coalesce("call_names", none).alias("call_names"), F.array_distinct(path_tokens(F.col("path"))).alias("path_tokens"), F.array_sort(F.array_distinct(F.array_compact(F.array(*hints)))).alias("role_hints"),
    )

    def line(label: str, column: str):
        return F.when(F.size(column) > 0, F.concat(F.lit(label + " "), F.array_join(column, ", ")))

    parts = [("path tokens", "path_tokens"), ("role hints", "role_hints"), ("exports", "exports"), ("imports", "imports"), ("call names", "call_names"), ("top symbols", "top_symbols")]
    return r.withColumn("summary", F.concat_ws("\n", F.concat(F.lit("file "), "path"), *[line(a, b) for a, b in parts]))


def symbol_skeletons(symbols: DataFrame) -> DataFrame:
    """symbols(id, file_path, name, type, parent_id) -> (symbol_id, path, name, signature, parent_name); a method's name follows its parent's."""
    parent = symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    s = symbols.join(parent, "parent_id", "left")
    owner = F.when((F.col("type") == "Method") & F.col("parent_name").isNotNull(), F.concat("parent_name", F.lit("."))).otherwise("")
    return s.select(F.col("id").alias("symbol_id"), F.col("file_path").alias("path"), "name", F.concat("type", F.lit(" "), owner, "name").alias("signature"), "parent_name")


def recall(files: DataFrame, symbols: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """file and symbol skeletons, queries(query_id, query) -> (query_id, path, score): the best files by any query term.

    Both skeletons are ranked by BM25, the first `limit` of each taken, and a file keeps its best score; `limit` files a query.
    """
    f = files.select("path", F.concat_ws(" ", "summary", F.array_join("imports", " "), F.array_join("exports", " "), F.array_join("top_symbols", " ")).alias("text"))
    s = symbols.select("symbol_id", "path", F.concat_ws(" ", "name", "signature", "parent_name").alias("text"))
    order = F.col("score").desc()
    a = top_k(bm25_best(f, ["path"], "text", queries, limit), ["query_id"], [order, "path"], limit)
    b = top_k(bm25_best(s, ["symbol_id", "path"], "text", queries, limit), ["query_id"], [order, "symbol_id"], limit)
    best = a.select("query_id", "path", "score").union(b.select("query_id", "path", "score")).groupBy("query_id", "path").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [order, "path"], limit).drop("rank")


def chunks_of(hits: DataFrame, chunks: DataFrame, queries: DataFrame, per_file: int = 2) -> DataFrame:
    """The chunks of each hit file that hold most query tokens anywhere in breadcrumb or code, earlier ones first among equals."""
    words = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("words"))
    r = hits.join(words, "query_id").join(chunks.select("path", "chunk_index", F.lower(F.concat_ws(" ", "breadcrumb", "code")).alias("hay")), "path")
    r = r.select("query_id", "path", "chunk_index", "score", F.size(F.filter("words", lambda w: F.contains(F.col("hay"), w))).alias("overlap"))
    return top_k(r, ["query_id", "path"], [F.col("overlap").desc(), "chunk_index"], per_file).drop("rank")
