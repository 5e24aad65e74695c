"""Retrieval queries: BM25, k-NN, fusion, cut-offs, packing, expansion and overlap scoring over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import blockmax, expand, fts, fusion, vector
from kelpline.operators.best import bm25_best
from kelpline.plans.registry import Family
from kelpline.sources import fixtures as X
from kelpline.sources.store import saved

family = Family()

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _bm25_sql(docs: str, key: str, text: str) -> str:
    """CTEs qt, scored (query_id, key, n_terms, score, matched) over docs(key, text) and benchmark."""
    tok = _TOK.format(text)
    return f"""qt AS (SELECT query_id, len(l) AS n_terms, unnest(l) AS term FROM (SELECT item_id AS query_id, list_distinct({_TOK.format("text")}) AS l FROM benchmark)),
toks AS (SELECT {key}, {tok} AS l FROM {docs}), stats AS (SELECT count(*) AS n_docs, avg(len(l)) AS avg_length FROM toks),
post AS (SELECT {key}, length, term, count(*) AS tf FROM (SELECT {key}, len(l) AS length, unnest(l) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT q.query_id, {", ".join("p." + k.strip() for k in key.split(","))}, q.n_terms, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score, count(*) AS matched
  FROM post p JOIN qt q ON q.term = p.term JOIN dfs d ON d.term = p.term CROSS JOIN stats GROUP BY ALL)"""


def _two_phase_sql(key: str, limit: int) -> str:
    return f"""tp_a AS (SELECT *, matched = n_terms AS strict, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS ar FROM scored),
tp_b AS (SELECT *, row_number() OVER (PARTITION BY query_id, strict ORDER BY score DESC, {key}) AS sr FROM tp_a),
tp_c AS (SELECT *, strict AND sr <= {limit} AS taken FROM tp_b), tp_d AS (SELECT *, sum(CAST(taken AS INT)) OVER (PARTITION BY query_id) AS ns FROM tp_c),
tp_e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS fr FROM tp_d WHERE NOT taken AND ar <= {limit} - ns + 10 AND n_terms > 1),
picked AS (SELECT query_id, {key}, score, 'strict' AS phase FROM tp_d WHERE taken UNION ALL SELECT query_id, {key}, score, 'relaxed' FROM tp_e WHERE fr <= {limit} - ns),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) - 1 AS rank FROM picked)"""


def file_hits(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The few hits of every query, saved: what joins them with files finds them small."""
    scored = bm25_best(X.files(spark, sf_dir), ["path"], "content", X.queries(spark, sf_dir), limit + 10)
    return saved(fts.two_phase(scored, ["path"], limit), "file-hits")


FILE_HITS = X.FILES + ", " + _bm25_sql("files", "path", "content") + ", " + _two_phase_sql("path", 20)


@family.add("r4_bm25_files", f"WITH {FILE_HITS} SELECT query_id, path, score, phase, rank FROM ranked")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_hits(spark, sf_dir)


CHUNK_HITS = X.CHUNKS + ", " + _bm25_sql("chunks", "path, chunk_index", "code") + ", " + _two_phase_sql("path, chunk_index", 40)


@family.add("r3_bm25_chunks", f"WITH {CHUNK_HITS} SELECT query_id, path, chunk_index, score, phase, rank FROM ranked")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["path", "chunk_index"]
    scored = bm25_best(X.files(spark, sf_dir), key, "code", X.queries(spark, sf_dir), 40 + 10, cut=X.lines, whole="content")
    return saved(fts.two_phase(scored, key, 40), "chunk-hits")


@family.add("r4_block_postings", f"WITH {FILE_HITS} SELECT query_id, path, score, phase, rank FROM ranked")
def r4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits from a saved index in blocks, which leaves out blocks by their bounds."""
    index = blockmax.build(X.files(spark, sf_dir), ["path"], "content")
    return fts.two_phase(blockmax.search(index, X.queries(spark, sf_dir), 20 + 10)[0], ["path"], 20)


VECTOR_HITS = """vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
dist AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(q[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) * (CAST(q[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE))))), 6) AS distance FROM vq CROSS JOIN embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) - 1 AS rank FROM dist QUALIFY rank < 60)"""


def vector_hits(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Neighbours of every twentieth vector, or of those of them whose query_id is in `of`."""
    e = X.load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn(e, q if of is None else q.join(of, "query_id", "left_semi"), 60)


@family.add("r2_knn", f"WITH {VECTOR_HITS} SELECT query_id, vec_id, distance, round(1 / (1 + distance), 6) AS score, rank FROM near")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir)


FUSED = f"""{FILE_HITS}, {VECTOR_HITS}, pairs AS (SELECT r.query_id, f.doc_id AS key, 'lexical' AS source, rank FROM ranked r JOIN files f ON f.path = r.path
  UNION ALL SELECT n.query_id, n.vec_id, 'vector', n.rank FROM near n WHERE n.query_id IN (SELECT item_id FROM benchmark)),
fused AS (SELECT query_id, key, round(sum(CASE source WHEN 'vector' THEN 0.6 ELSE 0.4 END / (20 + rank)), 9) AS score, CASE WHEN bool_or(source = 'vector') THEN 'vector' ELSE 'lexical' END AS source FROM pairs GROUP BY query_id, key)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector lists of an item, matched by number: item i, query vector i, document d and vector d."""
    lexical = file_hits(spark, sf_dir).join(X.files(spark, sf_dir).select("path", "doc_id"), "path").select("query_id", F.col("doc_id").alias("key"), F.lit("lexical").alias("source"), "rank")
    items = X.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    near = vector_hits(spark, sf_dir, items).select("query_id", F.col("vec_id").alias("key"), F.lit("vector").alias("source"), "rank")
    return fusion.rrf(lexical.union(near), ["key"], {"vector": 0.6, "lexical": 0.4})


@family.add("r1_reciprocal_rank_fusion", f"WITH {FUSED} SELECT query_id, key, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS rank FROM fused QUALIFY rank < 10")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.top_k(fused(spark, sf_dir), ["query_id"], [F.col("score").desc(), "key"], 10)
    return f.select("query_id", "key", "score", "source", "rank")


@family.add("j10_full_outer_key_merge", f"WITH {FUSED} SELECT query_id, key, score, source FROM fused")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "key", "score", "source")


# Scores in 0 .. 1 for the policies: the chunk ranking of every query, divided by its best.
SCALED = CHUNK_HITS + ", scaled AS (SELECT query_id, path AS file_path, chunk_index, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, rank AS position FROM ranked)"


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("query_id"))
    return r3(spark, sf_dir).select("query_id", F.col("path").alias("file_path"), "chunk_index", F.round(F.col("score") / top, 6).alias("score"), F.col("rank").alias("position"))


@family.add(
    "w7_rerank_pool",
    f"""WITH {SCALED}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, chunk_index) AS n, max(score) OVER (PARTITION BY query_id) AS top FROM scaled),
b AS (SELECT *, min(CASE WHEN n > 12 AND score < top * 0.6 THEN n END) OVER (PARTITION BY query_id) AS stop FROM a)
SELECT query_id, file_path, chunk_index, score, n FROM b WHERE n <= 24 AND (stop IS NULL OR n < stop)""",
)
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank_pool(scaled(spark, sf_dir), ["file_path", "chunk_index"]).select("query_id", "file_path", "chunk_index", "score", "n")


@family.add(
    "w6_smart_cutoff",
    f"""WITH {SCALED}, f AS (SELECT query_id, file_path, score, position FROM scaled), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) - 1 AS n, max(score) OVER (PARTITION BY query_id) AS top FROM f),
b AS (SELECT *, coalesce(min(CASE WHEN score < CASE WHEN n < 2 THEN 0.25 ELSE greatest(0.25, least(top * 0.5, top - 0.25)) END THEN n END) OVER (PARTITION BY query_id), 1000000) AS stop FROM a),
c AS (SELECT *, CASE WHEN top < 0.25 THEN n = 0 ELSE n < stop AND n < 8 END AS picked, row_number() OVER (PARTITION BY query_id, file_path ORDER BY n) = 1 AS one FROM b),
d AS (SELECT *, sum(CAST(picked AND one AS INT)) OVER (PARTITION BY query_id) AS kept, sum(CAST(NOT picked AND one AND score >= 0.25 AND top >= 0.25 AS INT)) OVER (PARTITION BY query_id ORDER BY n) AS fill FROM c)
SELECT query_id, file_path, score, position FROM d WHERE one AND (picked OR (score >= 0.25 AND top >= 0.25 AND kept + fill <= 2))""",
)
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.smart_cutoff(scaled(spark, sf_dir).select("query_id", "file_path", "score", "position"), ["file_path"])


@family.add("w2_first_per_key", f"WITH {SCALED} SELECT query_id, file_path, chunk_index, score FROM scaled QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY position) = 1")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_k(scaled(spark, sf_dir), ["query_id", "file_path"], ["position"], 1).select("query_id", "file_path", "chunk_index", "score")


@family.add("w3_top_k_per_group", f"WITH {SCALED} SELECT query_id, file_path, chunk_index, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, chunk_index) - 1 AS rank FROM scaled QUALIFY rank < 2")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_k(scaled(spark, sf_dir), ["query_id", "file_path"], [F.col("score").desc(), "chunk_index"], 2).select("query_id", "file_path", "chunk_index", "rank")


_BIAS = "CASE WHEN lower(file_path) LIKE 'src/%' THEN {} WHEN lower(file_path) LIKE 'tests/%' THEN {} WHEN lower(file_path) LIKE 'docs/%' OR lower(file_path) IN ('readme.md', 'readme_zh.md') THEN {} ELSE 1.0 END"
# Path biases by intent: fixed values.
_CANDIDATE = {"architecture": (1.2, 0.75, 0.65), "symbol_lookup": (1.2, 0.55, 0.45)}
_FILE = {"symbol_lookup": (1.25, 0.5, 0.4)}


def path_bias(path, intent, table: dict[str, tuple[float, float, float]]):
    """Score multiplier of a path for an intent."""
    low = F.lower(path)
    out = F.lit(1.0)
    for name, (src, tests, docs) in table.items():
        rule = F.when(low.startswith("src/"), src).when(low.startswith("tests/"), tests).when(low.startswith("docs/") | low.isin("readme.md", "readme_zh.md"), docs).otherwise(1.0)
        out = F.when(intent == name, rule).otherwise(out)
    return out


_PATHS = "SELECT s.query_id, CASE rank % 4 WHEN 0 THEN path WHEN 1 THEN 'tests/' || path WHEN 2 THEN 'docs/' || path ELSE 'README.md' END AS file_path, score, CASE query_id % 3 WHEN 0 THEN 'architecture' WHEN 1 THEN 'symbol_lookup' ELSE 'balanced' END AS intent FROM ranked s"


@family.add(
    "pf8_path_bias",
    f"""WITH {FILE_HITS}, v AS ({_PATHS}) SELECT query_id, file_path, intent, round(score * CASE intent WHEN 'architecture' THEN {_BIAS.format(1.2, 0.75, 0.65)} WHEN 'symbol_lookup' THEN {_BIAS.format(1.2, 0.55, 0.45)} ELSE 1.0 END, 6) AS candidate,
round(score * CASE intent WHEN 'symbol_lookup' THEN {_BIAS.format(1.25, 0.5, 0.4)} ELSE 1.0 END, 6) AS file_score FROM v""",
)
def pf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql(_PATHS.replace("ranked s", "{r} s"), r=file_hits(spark, sf_dir))
    a, b = (path_bias(F.col("file_path"), F.col("intent"), t) for t in (_CANDIDATE, _FILE))
    return v.select("query_id", "file_path", "intent", F.round(F.col("score") * a, 6).alias("candidate"), F.round(F.col("score") * b, 6).alias("file_score"))


# Seeds: the best three chunks of every query.
SEEDS = SCALED + ", seeds AS (SELECT s.query_id, s.file_path, s.chunk_index, s.score, s.file_path || ' > p' || s.chunk_index AS breadcrumb FROM scaled s WHERE position < 3)"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).filter("position < 3").select("query_id", "file_path", "chunk_index", "score", F.concat("file_path", F.lit(" > p"), F.col("chunk_index").cast("string")).alias("breadcrumb"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunks(spark, sf_dir).withColumnRenamed("path", "file_path")


@family.add(
    "j11_neighbour_expansion",
    f"""WITH {SEEDS}, r AS (SELECT s.query_id, s.file_path, c.chunk_index, abs(c.chunk_index - s.chunk_index) AS distance, s.score FROM seeds s JOIN chunks c ON c.path = s.file_path AND abs(c.chunk_index - s.chunk_index) BETWEEN 1 AND 2),
n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, file_path, chunk_index ORDER BY distance, score DESC) = 1)
SELECT n.query_id, n.file_path, n.chunk_index, n.distance, round(n.score * pow(0.8, n.distance), 9) AS score FROM n LEFT JOIN seeds s ON s.query_id = n.query_id AND s.file_path = n.file_path AND s.chunk_index = n.chunk_index WHERE s.query_id IS NULL""",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.neighbours(seeds(spark, sf_dir), file_chunks(spark, sf_dir))


@family.add(
    "j12_sibling_expansion",
    f"""WITH {SEEDS}, p AS (SELECT query_id, file_path AS parent, max(score) AS best FROM seeds GROUP BY ALL),
f AS (SELECT p.query_id, p.parent, c.path AS file_path, c.chunk_index, best FROM p JOIN chunks c ON c.path = p.parent LEFT JOIN seeds s ON s.query_id = p.query_id AND s.file_path = c.path AND s.chunk_index = c.chunk_index WHERE s.query_id IS NULL)
SELECT query_id, file_path, chunk_index, round(best * 0.7, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id, parent ORDER BY file_path, chunk_index) <= 3""",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.siblings(seeds(spark, sf_dir), file_chunks(spark, sf_dir))


# Links between files: document d leads to d * 7 % n and d * 11 % n; every tenth document is a barrel.
LINKS = "n AS (SELECT max(doc_id) + 1 AS n FROM files), links AS (SELECT DISTINCT a.path AS file_path, b.path AS target FROM files a CROSS JOIN n JOIN files b ON b.doc_id IN (a.doc_id * 7 % n.n, a.doc_id * 11 % n.n))"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir).select("doc_id", "path")
    n = f.agg(F.max("doc_id") + 1).first()[0]
    to = f.select(F.col("path").alias("file_path"), F.explode(F.array(F.col("doc_id") * 7 % n, F.col("doc_id") * 11 % n)).alias("doc_id"))
    return to.join(f.withColumnRenamed("path", "target"), "doc_id").select("file_path", "target").distinct()


@family.add(
    "j13_import_expansion",
    f"""WITH {SEEDS}, {LINKS}, s AS (SELECT query_id, file_path, max(score) AS score FROM seeds GROUP BY ALL),
a AS (SELECT s.query_id, s.file_path AS seed, l.target, s.score * 0.6 AS score, 0 AS depth FROM s JOIN links l ON l.file_path = s.file_path),
b AS (SELECT a.query_id, a.seed, l.target, a.score * 0.7, 1 FROM a JOIN files f ON f.path = a.target AND f.doc_id % 10 = 0 JOIN links l ON l.file_path = a.target),
u AS (SELECT query_id, seed, target, max(round(score, 9)) AS score, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE seed <> target GROUP BY ALL)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, seed ORDER BY depth, target) <= 3""",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    barrels = X.files(spark, sf_dir).filter("doc_id % 10 = 0").select(F.col("path").alias("file_path"))
    return expand.imports(seeds(spark, sf_dir), links(spark, sf_dir), barrels)


_SEGMENTS = "SELECT query_id, file_path, chunk_index AS start, score, CAST(100 + chunk_index % 7 * 900 AS BIGINT) AS length FROM scaled"


@family.add(
    "w5_greedy_budget_pack",
    f"""WITH {SCALED}, s AS ({_SEGMENTS}), a AS (SELECT *, max(score) OVER (PARTITION BY query_id, file_path) AS best FROM s QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, start) <= 3),
b AS (SELECT *, row_number() OVER w AS position, CAST(sum(length) OVER w AS BIGINT) AS used FROM a WINDOW w AS (PARTITION BY query_id ORDER BY best DESC, file_path, start))
SELECT query_id, file_path, start, score, length, position, used FROM b WHERE position <= 12 AND used <= 20000""",
)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.pack(spark.sql(_SEGMENTS.replace("FROM scaled", "FROM {s}"), s=scaled(spark, sf_dir)), max_chars=20000)


_SPANS = "SELECT l_orderkey, l_linenumber AS s, CAST(l_linenumber + floor(l_quantity / 10) AS INT) AS e, l_extendedprice AS score FROM {}"


@family.add(
    "w4_interval_merge",
    f"""WITH sp AS ({_SPANS.format("lineitem")}), a AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
c AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT l_orderkey, island, min(s) AS s, max(e) AS e, count(*) AS merged, max(score) AS score FROM c GROUP BY l_orderkey, island""",
)
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spark.sql(_SPANS.format("{li}"), li=X.load(spark, sf_dir, "lineitem"))
    return fusion.merge_intervals(spans, ["l_orderkey"], "s", "e", score=F.max("score"))


TERMS = "terms AS (SELECT item_id AS query_id, list_distinct(" + _TOK.format("text") + ") AS terms FROM benchmark)"


@family.add(
    "r7_token_overlap",
    rf"""WITH {X.FILES}, {TERMS}, {_bm25_sql("files", "path", "content")}, {_two_phase_sql("path", 20)}
SELECT r.query_id, r.path, list_sum(list_transform(t.terms, lambda x: CASE WHEN NOT contains(lower(f.content), x) THEN 0.0::DOUBLE WHEN list_contains({_TOK.format("f.content")}, x) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS overlap FROM ranked r JOIN files f ON f.path = r.path JOIN terms t ON t.query_id = r.query_id""",
)
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.queries(spark, sf_dir).select("query_id", F.array_distinct(T.tokens(F.col("query"))).alias("terms"))
    hits = file_hits(spark, sf_dir).join(X.files(spark, sf_dir).select("path", "content"), "path").join(q, "query_id")
    return hits.select("query_id", "path", T.overlap_score(F.col("content"), F.col("terms")).alias("overlap"))


@family.add(
    "r6_file_hit_chunk_selection",
    rf"""WITH {X.CHUNKS}, {TERMS}, {_bm25_sql("files", "path", "content")}, {_two_phase_sql("path", 20)},
o AS (SELECT r.query_id, r.path, r.score, r.rank, c.chunk_index, list_sum(list_transform(t.terms, lambda x: CASE WHEN NOT contains(lower(c.code), x) THEN 0.0::DOUBLE WHEN list_contains({_TOK.format("c.code")}, x) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS overlap
  FROM ranked r JOIN chunks c ON c.path = r.path JOIN terms t ON t.query_id = r.query_id),
p AS (SELECT *, round(score * (1 + 0.5 * overlap), 9) AS chunk_score FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY overlap DESC, chunk_index) <= 2)
SELECT query_id, path, chunk_index, overlap, chunk_score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, overlap DESC, chunk_index) <= 40""",
)
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.queries(spark, sf_dir).select("query_id", F.array_distinct(T.tokens(F.col("query"))).alias("terms"))
    hits = file_hits(spark, sf_dir).join(X.chunks(spark, sf_dir).select("path", "chunk_index", "code"), "path").join(q, "query_id")
    o = hits.withColumn("overlap", T.overlap_score(F.col("code"), F.col("terms"))).filter("overlap > 0")
    p = fusion.top_k(o, ["query_id", "path"], [F.col("overlap").desc(), "chunk_index"], 2, "n")
    p = fusion.top_k(p, ["query_id"], ["rank", F.col("overlap").desc(), "chunk_index"], 40, "m")
    return p.select("query_id", "path", "chunk_index", "overlap", F.round(F.col("score") * (1 + 0.5 * F.col("overlap")), 9).alias("chunk_score"))


@family.add(
    "j9_chunk_hit_join",
    f"WITH {CHUNK_HITS} SELECT r.query_id, c.path, c.chunk_index, c.hash, length(c.code) AS n_chars, r.score FROM ranked r JOIN chunks c ON c.path = r.path AND c.chunk_index = r.chunk_index",
)
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.chunks(spark, sf_dir).select("path", "chunk_index", "hash", F.length("code").alias("n_chars"))
    return r3(spark, sf_dir).join(c, ["path", "chunk_index"]).select("query_id", "path", "chunk_index", "hash", "n_chars", "score")


def holders(files: DataFrame, items: DataFrame) -> DataFrame:
    """files(path, content), items(query_id, query) -> (query_id, path) of every file that holds an item's text.

    A text that holds an item of six pieces or more (between blanks and line breaks) has its second to fifth piece as pieces
    of its own: an equality that the containment test follows. The few shorter items meet every file.
    """
    pieces = lambda c: F.split(F.regexp_replace(c, "\n", " "), " ")
    four = lambda words: lambda i: F.array_join(F.slice(words, i, 4), " ")
    keyed = items.withColumn("pieces", pieces(F.col("query")))
    long = keyed.filter(F.size("pieces") >= 6).select("query_id", "query", four(F.col("pieces"))(F.lit(2)).alias("k"))
    short = keyed.filter(F.size("pieces") < 6).select("query_id", "query")
    # The pieces of a text are cut once, not once for each place.
    grams = T.bound(pieces(F.col("content")), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), four(w))))
    met = files.select("path", "content", F.explode(grams).alias("k")).join(long, "k").filter(F.contains("content", "query")).select("query_id", "path").distinct()
    return met.unionByName(files.join(short, F.contains("content", "query")).select("query_id", "path"))


@family.add(
    "a25_retrieval_quality",
    f"""WITH {FILE_HITS}, e AS (SELECT b.item_id AS query_id, f.path FROM benchmark b JOIN files f ON contains(f.content, b.text)),
h AS (SELECT e.query_id, count(*) AS expected, count(r.path) FILTER (WHERE r.rank < 5) AS hits FROM e LEFT JOIN ranked r ON r.query_id = e.query_id AND r.path = e.path GROUP BY e.query_id)
SELECT count(*) AS cases, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5, round(avg(hits / expected), 6) AS coverage FROM h""",
)
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and coverage of the files that hold an item."""
    e = holders(X.files(spark, sf_dir).select("path", "content"), X.queries(spark, sf_dir))
    r = file_hits(spark, sf_dir).select("query_id", "path", "rank")
    h = e.join(r, ["query_id", "path"], "left").groupBy("query_id").agg(F.count("*").alias("expected"), F.count_if(F.col("rank") < 5).alias("hits"))
    return h.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit_at_5"), F.round(F.avg(F.col("hits") / F.col("expected")), 6).alias("coverage"))
