"""Query intents and the search settings that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that tell an intent, in English and Chinese: fixed values.
ARCHITECTURE_WORDS = "architecture boundary entrypoint startup adapter adaptation handler service workflow coupling coupled mode layer 边界 架构 入口 启动 适配 模式 链路".split()
CONCEPT_WORDS = "how why what flow architecture concept 流程 原理 架构 实现 如何".split()
BOUNDARY_TYPES = "Service Controller Handler Adapter Workflow Router".split()
ROOT_FOLDERS = "src tests docs packages apps lib dist scripts".split()

CODE_LIKE = r"[A-Z_.]"
ARCHITECTURE, CONCEPT = ("(?i)" + "|".join(words) for words in (ARCHITECTURE_WORDS, CONCEPT_WORDS))
BOUNDARY = rf"(?:{'|'.join(BOUNDARY_TYPES)})(?:\.|$)"


def looks_like_path(word: Column) -> Column:
    """Whether a word with a separator begins at a known place (here, above, a drive, a root folder) or ends in a file extension."""
    folded = F.replace(F.lower(word), F.lit("\\"), F.lit("/"))
    head = F.substring_index(folded, "/", 1)
    drive = (F.length(head) == 2) & F.endswith(head, F.lit(":")) & head.between("a:", "z:") & F.startswith(word.substr(3, 1), F.lit("\\"))
    dotted = head.isin(".", "..") & (word.substr(F.length(head) + 1, F.lit(1)) == "/")
    extension = F.substring_index(folded, ".", -1)
    behind = F.length(folded) - F.length(extension) - F.length(head) - 2  # characters between the first separator and the last dot
    named = F.contains(folded, F.lit(".")) & (behind >= 1) & F.regexp_like(extension, F.lit("^[a-z0-9]+$"))
    return F.contains(folded, F.lit("/")) & (dotted | drive | head.isin(*ROOT_FOLDERS) | named)


# Settings by intent: fixed values.
DEFAULTS = {"w_vec": 0.6, "w_lex": 0.4, "rerank_top_n": 10, "rerank_min_pool": 12, "rerank_max_pool": 24, "smart_min_k": 2, "smart_max_k": 8, "skeleton": False, "graph": False}
CHANGES = {
    "symbol_lookup": {"w_vec": 0.35, "w_lex": 0.65, "graph": True, "rerank_top_n": 8, "rerank_min_pool": 10, "rerank_max_pool": 16},
    "navigation": {"w_vec": 0.3, "w_lex": 0.7, "skeleton": True, "graph": True, "rerank_top_n": 6, "rerank_min_pool": 8, "rerank_max_pool": 12},
    "architecture": {"w_vec": 0.25, "w_lex": 0.75, "skeleton": True, "graph": True, "rerank_top_n": 8, "rerank_min_pool": 10, "rerank_max_pool": 16, "smart_min_k": 4, "smart_max_k": 8},
    "conceptual": {"w_vec": 0.55, "w_lex": 0.45},
    "balanced": {},
}


def intent(query: Column, technical_terms: Column) -> Column:
    """navigation, symbol_lookup, architecture, conceptual or balanced, by counts of telling words."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")

    def n(pattern: str, but: str | None = None, unless: str | None = None) -> Column:
        def test(w: Column) -> Column:
            hit = F.regexp_like(w, F.lit(pattern))
            if but:
                hit = hit & (~F.regexp_like(w, F.lit(but)) | (F.regexp_like(w, F.lit(unless)) if unless else F.lit(False)))
            return hit

        return F.size(F.filter(words, test))

    path = F.size(F.filter(words, looks_like_path))
    natural = n(ARCHITECTURE, CODE_LIKE)
    strong = (natural >= 2) | ((natural >= 1) & (F.size(words) >= 8))
    return (
        F.when(path >= 1, "navigation")
        .when((F.size(technical_terms) > 0) & ~strong, "symbol_lookup")
        .when(n(ARCHITECTURE, CODE_LIKE, BOUNDARY) >= 1, "architecture")
        .when((F.size(words) <= 6) & (n(CODE_LIKE) >= 1), "symbol_lookup")
        .when(n(CONCEPT) >= 1, "conceptual")
        .otherwise("balanced")
    )


def settings(spark: SparkSession) -> DataFrame:
    """One row of search settings for each intent."""
    rows = []
    for name, change in CHANGES.items():
        row = {**DEFAULTS, **change}
        rows.append("(" + ", ".join([f"'{name}'", *[f"{v}D" if isinstance(v, float) else str(v).lower() for v in row.values()]]) + ")")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS s(intent, {', '.join(DEFAULTS)})")
