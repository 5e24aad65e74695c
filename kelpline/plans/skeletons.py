"""Queries of file and symbol skeletons over modules made from documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import skeleton as K
from kelpline.plans import retrieval as Q
from kelpline.plans.registry import Family
from kelpline.sources import fixtures as X

family = Family()

# Modules: a document's text below two imports; its words of eight letters or more are functions, or methods of a class.
_MODULES = """SELECT doc_id, source, text, concat('src/', CASE doc_id % 5 WHEN 0 THEN 'cli/' WHEN 1 THEN 'mcp/' WHEN 2 THEN 'commands/' ELSE '' END, source, '/unit', cast(doc_id AS string), CASE WHEN doc_id % 4 = 0 THEN '/index.ts' ELSE 'Main.ts' END) AS path,
concat('import a from "./n', cast(doc_id % 7 AS string), '";\nexport * from "../', source, '";\n', text, CASE WHEN doc_id % 9 = 0 THEN ' CLI.parse()' ELSE '' END) AS content FROM {d}"""
MODULES = f"""modules AS ({_MODULES.replace("{d}", "documents").replace("AS string", "AS varchar")}),
words AS (SELECT path, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{8,}}'))) AS w FROM modules),
syms AS (SELECT path || ':class' AS id, path, source || 'Service' AS name, 'Class' AS type, true AS exported, NULL AS parent_id FROM modules
  UNION ALL SELECT path || ':' || w, path, w, CASE WHEN len(w) % 3 = 0 THEN 'Method' ELSE 'Function' END, len(w) % 2 = 0, CASE WHEN len(w) % 3 = 0 THEN path || ':class' END FROM words)"""
_PARTS = r"list_filter(string_split_regex(lower(regexp_replace(m.path, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
SKELETONS = rf"""{MODULES}, per AS (SELECT path, coalesce(list(name ORDER BY name) FILTER (WHERE exported), []) AS exports, coalesce(list(type || ' ' || name ORDER BY type || ' ' || name) FILTER (WHERE parent_id IS NULL), []) AS top_symbols FROM syms GROUP BY path),
own AS (SELECT m.path, p.exports, p.top_symbols, list_sort(list_distinct(['./n' || (doc_id % 7), '../' || source, './g' || (doc_id % 3)])) AS imports, list_sort(list_distinct(['fn' || (doc_id % 6), 'fn' || (doc_id % 10)])) AS call_names, {_PARTS} AS l,
  list_sort(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'entrypoint' END, CASE doc_id % 5 WHEN 0 THEN 'cli' WHEN 1 THEN 'mcp' WHEN 2 THEN 'command handler' END, CASE WHEN doc_id % 9 = 0 THEN 'cli startup' END, 'core service'], lambda h: h IS NOT NULL)) AS role_hints FROM modules m JOIN per p ON p.path = m.path),
sk AS (SELECT * EXCLUDE (l), list_filter(l, lambda t, i: list_position(l, t) = i) AS path_tokens FROM own),
fs AS (SELECT *, array_to_string(list_filter(['file ' || path, 'path tokens ' || array_to_string(path_tokens, ', '), 'role hints ' || array_to_string(role_hints, ', '), 'exports ' || array_to_string(exports, ', '), 'imports ' || array_to_string(imports, ', '), 'call names ' || array_to_string(call_names, ', '), 'top symbols ' || array_to_string(top_symbols, ', ')], lambda x: x IS NOT NULL), chr(10)) AS summary FROM sk)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MODULES, d=X.load(spark, sf_dir, "documents"))


def symbols(m: DataFrame) -> DataFrame:
    path, w = F.col("file_path"), F.col("w")
    w3, cls = F.length("w") % 3 == 0, F.concat("file_path", F.lit(":class"))
    words = m.select(F.col("path").alias("file_path"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))).alias("w"))
    top = m.select(F.concat("path", F.lit(":class")).alias("id"), F.col("path").alias("file_path"), F.concat("source", F.lit("Service")).alias("name"), F.lit("Class").alias("type"), F.lit(True).alias("exported"), F.lit(None).cast("string").alias("parent_id"))
    return top.union(words.select(F.concat(path, F.lit(":"), w), path, w, F.when(w3, "Method").otherwise("Function"), F.length("w") % 2 == 0, F.when(w3, cls)))


def file_skeletons(m: DataFrame) -> DataFrame:
    n = F.col("doc_id")
    imports = m.select(F.col("path").alias("file_path"), F.concat(F.lit(" ./g"), (n % 3).cast("string"), F.lit(" ")).alias("source"))
    calls = m.select(F.col("path").alias("file_path"), F.explode(F.array(*[F.concat(F.lit("fn"), (n % k).cast("string")) for k in (6, 10)])).alias("callee"))
    return K.file_skeletons(m, symbols(m), imports, calls)


@family.add("g12_file_skeletons", f"WITH {SKELETONS} SELECT path, array_to_string(imports, ',') AS imports, array_to_string(exports, ',') AS exports, array_to_string(top_symbols, ',') AS top_symbols, array_to_string(call_names, ',') AS call_names, array_to_string(role_hints, ',') AS role_hints, summary FROM fs")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = file_skeletons(modules(spark, sf_dir))
    return s.select("path", *[F.array_join(c, ",").alias(c) for c in ("imports", "exports", "top_symbols", "call_names", "role_hints")], "summary")


@family.add("g12_symbol_skeletons", f"WITH {MODULES} SELECT s.id AS symbol_id, s.path, s.name, s.type || ' ' || CASE WHEN s.type = 'Method' THEN p.name || '.' ELSE '' END || s.name AS signature, p.name AS parent_name FROM syms s LEFT JOIN syms p ON p.id = s.parent_id")
def g12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.symbol_skeletons(symbols(modules(spark, sf_dir)))


def _named(prefix: str, sql: str) -> str:
    return re.sub(r"\b(qt|toks|stats|post|dfs|scored)\b", prefix + r"\1", sql)


_RECALL_SQL = f"""WITH {SKELETONS}, fd AS (SELECT path, concat_ws(' ', summary, array_to_string(imports, ' '), array_to_string(exports, ' '), array_to_string(top_symbols, ' ')) AS txt FROM fs),
sd AS (SELECT s.id AS symbol_id, s.path, concat_ws(' ', s.name, s.type || ' ' || CASE WHEN s.type = 'Method' THEN p.name || '.' ELSE '' END || s.name, p.name) AS txt FROM syms s LEFT JOIN syms p ON p.id = s.parent_id),
{_named("f_", Q._bm25_sql("fd", "path", "txt"))}, {_named("s_", Q._bm25_sql("sd", "symbol_id, path", "txt"))},
u AS (SELECT query_id, path, score FROM f_scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 6 UNION ALL SELECT query_id, path, score FROM s_scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) <= 6),
h AS (SELECT * FROM (SELECT query_id, path, max(score) AS score FROM u GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 6),
c AS (SELECT path, string_split(content, chr(10)) AS lines FROM modules), ch AS (SELECT path, CAST(i AS INTEGER) AS chunk_index, lower(path || ' ' || lines[i + 1]) AS hay FROM c, unnest(range(len(lines))) t(i)), {Q.TERMS}
SELECT h.query_id, h.path, ch.chunk_index, h.score, CAST(len(list_filter(terms, lambda t: contains(hay, t))) AS INTEGER) AS overlap FROM h JOIN ch ON ch.path = h.path JOIN terms ON terms.query_id = h.query_id QUALIFY row_number() OVER (PARTITION BY h.query_id, h.path ORDER BY overlap DESC, chunk_index) <= 2"""


@family.add("r8_skeleton_recall", _RECALL_SQL)
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their own and their symbols' skeletons, and of each the chunks that share most with the query."""
    m, q = modules(spark, sf_dir), X.queries(spark, sf_dir)
    hits = K.recall(file_skeletons(m), K.symbol_skeletons(symbols(m)), q)
    chunks = m.select("path", F.col("path").alias("breadcrumb"), F.posexplode(F.split("content", "\n")).alias("chunk_index", "code"))
    return K.chunks_of(hits, chunks, q).select("query_id", "path", "chunk_index", "score", "overlap")
