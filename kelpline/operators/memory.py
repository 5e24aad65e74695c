"""Knowledge-base operators: status, relevance scores, routing, diversity selection, merging, similarity advice, extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.functions.language import glob_regex
from kelpline.operators.fusion import top_k
from kelpline.sources.store import saved

STATUS_WEIGHT = {"active": 8, "stale": -8, "expired": -20, "superseded": -16}
CONFIRMED_WEIGHT = {"human-confirmed": 6, "agent-inferred": 2, "suggested": -100}
ROUTES = {"explicit-module": 3.0, "path": 2.4, "keyword": 2.0, "explicit-scope": 1.2, "scope-cascade": 0.7}


# What equal titles, equal summaries and nearly equal terms add to the share of terms in common.
SAME_TITLE, SAME_SUMMARY, ALIKE = 0.18, 0.22, 0.2


def status(now: Column, stale_days: int, provenance: str = "provenance", until: str = "valid_until", updated: str = "updated_at") -> Column:
    """superseded, expired (a bare date ends with its day), stale, or active."""
    over = F.col(until).cast("timestamp") + F.expr("INTERVAL 1 DAY") <= now
    old = now - F.col(updated).cast("timestamp") > F.expr(f"INTERVAL {stale_days} DAYS")
    return F.when(F.col(provenance).startswith("superseded-by:"), "superseded").when(over, "expired").when(old, "stale").otherwise("active")


def prunable(state: Column, expired: bool = True, stale: bool = False) -> Column:
    return F.coalesce((state.isin("expired", "superseded") & F.lit(expired)) | ((state == "stale") & F.lit(stale)), F.lit(False))


def recency(now: Column, updated: Column) -> Column:
    age = (F.unix_timestamp(now) - F.unix_timestamp(updated.cast("timestamp"))) / 86400
    return F.when(age <= 7, 5).when(age <= 30, 2).otherwise(0)


def any_term(value: Column, terms: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.exists(terms, lambda t: F.contains(low, t))


def weight_of(value: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, w in table.items():
        out = F.when(value == k, w).otherwise(out)
    return out


def memory_score(terms: Column, state: Column, now: Column) -> Column:
    """Relevance of a long-term memory to query terms: fields, tags, entities, confidence, status and recency."""
    tags = F.size(F.filter("tags", lambda t: any_term(t, terms)))
    fields = F.lit(0)
    for name, w in (("title", 20), ("summary", 12), ("type", 2), ("fact_key", 10)):
        fields = fields + F.when(any_term(F.col(name), terms), w).otherwise(0)
    return fields + tags * 4 + F.least(F.lit(10), tags * 2) + F.floor(F.col("confidence") * 10 + 0.5) + weight_of(state, STATUS_WEIGHT, -16) + recency(now, F.col("updated_at"))


def feature_score(terms: Column, exact: Column, files: Column, dirs: Column) -> Column:
    """Relevance of a feature memory: query terms, exact names, files or folders in the result, confirmation."""
    hay = F.lower(F.concat_ws(" ", "name", "responsibility", F.array_join("exports", " ")))
    hits = F.size(F.filter(terms, lambda t: F.contains(hay, t)))
    names = F.concat(F.array(F.lower("name")), F.transform("exports", lambda e: F.lower(e)))
    paths = F.transform("files", lambda f: F.concat("dir", F.lit("/"), f))
    place = F.when(F.arrays_overlap(paths, files), 16).when(F.array_contains(dirs, F.col("dir")), 8).otherwise(0)
    return F.when(hits > 0, 6 + hits * 2).otherwise(0) + F.when(F.arrays_overlap(names, exact), 12).otherwise(0) + place + weight_of(F.col("confirmation_status"), CONFIRMED_WEIGHT, 4)


def path_matches(path: Column, trigger: Column) -> Column:
    """A trigger path equals a path, is a folder over it, or is a glob that fits."""
    bare = F.regexp_replace(trigger, "/$", "")
    return F.when(F.contains(trigger, F.lit("*")), F.regexp_like(path, glob_regex(trigger))).otherwise((path == bare) | F.startswith(path, F.concat(bare, F.lit("/"))))


def keyword_matches(query: Column, keywords: Column) -> Column:
    """A query token of two characters or more lies in a keyword, or a keyword in a token of five or more."""
    parts = F.filter(F.split(F.lower(query), r"[\s,/_-]+"), lambda t: F.length(t) >= 2)
    return F.exists(keywords, lambda k: F.exists(parts, lambda t: F.contains(F.lower(k), t) | ((F.length(t) >= 5) & F.contains(t, F.lower(k)))))


def route_signal(matches: DataFrame, by: list[str]) -> DataFrame:
    """Best route weight plus at most 1 of the others'."""
    w = F.lit(0.0)
    for k, v in ROUTES.items():
        w = F.when(F.col("matched_by") == k, v).otherwise(w)
    g = matches.groupBy(*by).agg(F.max(w).alias("best"), F.sum(w).alias("all_"))
    return g.select(*by, (F.col("best") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("all_") - F.col("best")))).alias("signal"))


def scope_of(folder: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(T.normal_path(folder), "/+$", ""), "^src/+", "")
    return F.when(F.coalesce(folder, F.lit("")) == "", "default").when(clean == "", "root").otherwise(F.regexp_replace(clean, "/", "-"))


def mmr(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """(query_id, id, relevance, terms) -> each query's k picks, every one weighing relevance against likeness to those before.

    Selection is sequential, so a query's candidates meet in one Python call; callers pass a bounded pool a query.
    """

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id"]).reset_index(drop=True)
        low, high = pdf.relevance.min(), pdf.relevance.max()
        norm = (pdf.relevance - low) / (high - low) if high > low else pdf.relevance * 0 + 1.0
        sets, left, out = [set(t) for t in pdf.terms], list(range(len(pdf))), []
        while left and len(out) < k:
            like = [max((len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5 if sets[i] and sets[j] else 0.0 for j in out), default=0.0) for i in left]
            best = max(range(len(left)), key=lambda n: (weight * norm[left[n]] - (1 - weight) * like[n], pdf.relevance[left[n]], -n))
            out.append(left.pop(best))
        return pd.DataFrame({"query_id": key[0], "id": pdf.id[out].to_list(), "position": range(len(out))})

    kind = candidates.schema["id"].dataType.simpleString(), candidates.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {kind[1]}, id {kind[0]}, position int")


def merge_memories(rows: DataFrame) -> DataFrame:
    """Memories with the same fact key, or else the same content, become one: longest summary, highest confidence, all tags."""
    key = F.coalesce(F.concat(F.lit("f:"), "fact_key"), F.concat(F.lit("h:"), T.content_hash(F.col("summary"))))
    g = rows.withColumn("merge_key", key).groupBy("project_id", "type", "scope", "merge_key")
    return g.agg(
        F.count("*").alias("merged"), F.max_by("summary", F.struct(F.length("summary"), F.col("id"))).alias("summary"), F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.max("updated_at").alias("updated_at"),
        F.when(F.bool_or(F.col("source") == "user-explicit"), "user-explicit").otherwise("agent-inferred").alias("source"),
    )


def advise(items: DataFrame, block: list[str], least: float = 0.45, k: int = 3) -> DataFrame:
    """(id, terms, title, summary, block...) -> each item's k most similar others within its block. Terms follow from the title.

    Items of equal content are one class, of which the k + 1 least ids can be advice to anybody; classes are compared. The
    score reaches `least` only where the smaller of two classes shares that part of its terms with the other, or
    SAME_SUMMARY less where the summaries are equal. So one of its rarest terms is shared, as many as may be missed and one
    more, and only these are joined: common terms bring no two classes together unless a title has little else.

    A pair is scored where it meets, at the first of those terms that both have, so no pair is shuffled before a task has
    cut its own to the best of each class: by score and the least id, k + 1 classes give every row that can be wanted.
    """
    low = lambda c: F.lower(F.trim(c))
    mark = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    t = items.dropna(subset=block).select("id", *block, "terms", low("title").alias("title"), low("summary").alias("summary")).filter(F.size("terms") > 0)
    # Texts are compared for equality alone: 16 bytes of their SHA-256 stand for them.
    t = t.select("id", *block, "terms", mark("title").alias("title"), mark("summary").alias("summary"), mark(F.to_json(F.struct(*block, "terms", "title", "summary"))).alias("class"))
    t = saved(t.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("id"))), "advice-items")
    members = t.filter(F.col("place") <= k + 1).select(F.col("class").alias("b"), F.col("id").alias("b_id"))
    c = t.filter("place = 1").select("class", F.col("id").alias("least"), *block, "terms", "title", "summary", F.size("terms").alias("n"))
    words = c.select(*block, F.explode("terms").alias("term"))
    df = words.groupBy(*block, "term").agg(F.count("*").alias("df"))
    terms = c.withColumn("term", F.explode("terms"))
    ranked = terms.select("class", *block, "term").join(df, [*block, "term"]).groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("rare"))
    c = saved(c.join(ranked, "class"), "advice-classes")
    columns = ("class", "least", "terms", "title", "summary", "n")
    same = F.coalesce(F.col("a_summary") == F.col("b_summary"), F.lit(False))

    def meet(share: float, on: list[str]) -> DataFrame:
        """Pairs (a, b) of which a has no more terms, that may share so much of a's, each once."""
        first = F.slice("rare", 1, (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int"))
        key = [F.col(x).alias(f"on_{x}") for x in on]
        x = c.select(*key, *[F.col(y).alias(f"a_{y}") for y in columns], first.alias("first")).withColumn("term", F.explode("first"))
        y = c.select(*key, *[F.col(y).alias(f"b_{y}") for y in columns], F.explode("terms").alias("term"))
        r = x.join(y, [*[f"on_{x}" for x in on], "term"]).filter("a_n < b_n OR (a_n = b_n AND a_class < b_class)")
        return r.filter(F.element_at(F.array_intersect("first", "b_terms"), 1) == F.col("term")).drop("first", "term", *[f"on_{x}" for x in on])

    met = meet(least, block).filter(~same).unionByName(meet(max(0.0, least - SAME_SUMMARY), [*block, "summary"]))
    r = met.withColumn("both", F.size(F.array_intersect("a_terms", "b_terms")))
    jaccard = F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both"))
    score = F.col("both") / F.least("a_n", "b_n") + F.when(F.col("a_title") == F.col("b_title"), SAME_TITLE).otherwise(0.0)
    score = score + F.when(F.col("a_summary") == F.col("b_summary"), SAME_SUMMARY).otherwise(0.0) + F.when(jaccard >= 0.8, ALIKE).otherwise(0.0)
    r = r.withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
    way = lambda a, b: F.struct(F.col(f"{a}_class").alias("a"), F.col(f"{b}_class").alias("b"), F.col(f"{b}_least").alias("least"))
    both_ways = r.select("score", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.*", "score")
    alone = F.lit(1.0) + F.when(F.col("title").isNotNull(), SAME_TITLE).otherwise(0.0) + F.when(F.col("summary").isNotNull(), SAME_SUMMARY).otherwise(0.0) + F.lit(ALIKE)
    own = c.select(F.col("class").alias("a"), F.col("class").alias("b"), "least", F.round(alone, 6).alias("score")).filter(F.col("score") >= least)
    # A bare row number under its bound: Spark then cuts each task's rows before the shuffle (a window group limit).
    nearest = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "least"))
    near = both_ways.unionByName(own).withColumn("place", nearest).filter(F.col("place") <= k + 1).select("a", "b", "score")
    best = top_k(near.join(members, "b").select("a", "b_id", "score"), ["a"], [F.col("score").desc(), "b_id"], k + 1, "place").drop("place")
    own = t.select(F.col("class").alias("a"), F.col("id").alias("a_id")).join(best, "a").filter("a_id <> b_id")
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.col("score").desc(), "b_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("a_id", "b_id", "score", "rank")


def extract(rows: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(id, text) -> one memory for each sentence and rule (type, pattern, confidence), with links, a date and a stable id."""
    s = rows.select("id", F.explode(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), r"[.!?] *"), lambda x: x != "")).alias("sentence"))
    rule = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("pattern"), F.lit(c).alias("confidence")) for t, p, c in rules])
    hit = s.withColumn("r", F.explode(rule)).filter(F.regexp_like("sentence", F.col("r.pattern")))
    return hit.select(
        "id", F.col("r.type").alias("type"), "sentence", F.col("r.confidence").alias("confidence"), F.regexp_extract_all("sentence", F.lit(r"(https?://[^\s]+)"), F.lit(1)).alias("links"),
        F.nullif(F.regexp_extract("sentence", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("valid_until"), F.substring(F.sha1(F.concat("r.type", F.lit(":"), "sentence")), 1, 12).alias("memory_id"),
    )


def split_lines(rows: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Contiguous chunks of whole lines, each of at most `budget` solid characters (a longer line stands alone).

    The greedy cut restarts at every overflow, so it is a scan over a text's lines; Arrow batches carry it to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                start = size = n = at = 0
                for line in (t or "").split("\n"):
                    solid = sum(c not in " \t\r" for c in line)
                    if at > start and size + solid > budget:
                        out.append((k, n, start, at - 1))
                        start, size, n = at, 0, n + 1
                    size += solid
                    at += len(line) + 1
                out.append((k, n, start, at - 1))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "start", "end"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, start int, end int")


def find_by_path(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """requests(request_id, path), memories(id, name, dir, files) -> (request_id, tier, id), null where nothing is found.

    Tiers: 'record', a path features/<module>.json by the module's name; 'exact', a file by its whole path; 'basename', a
    bare file name that one file alone has; 'suffix', the end of one file's path alone. A bare name never goes by suffix.
    Ties of the first two go to the least id. Files are joined by every suffix of their path, so all joins are equal ones,
    and what is looked up is one row a key, however many memories share it.
    """
    r = requests.select("request_id", F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^/+", "").alias("want"))
    full = F.regexp_replace(F.concat(F.regexp_replace(F.regexp_replace("dir", r"\\", "/"), "/$", ""), F.lit("/"), "file"), "/{2,}", "/")
    f = memories.select("id", "dir", F.explode("files").alias("file")).select("id", full.alias("full"), F.element_at(F.split(F.regexp_replace("file", r"\\", "/"), "/"), -1).alias("base"))
    record = r.filter("startswith(want, 'features/')").select("request_id", F.regexp_replace(F.element_at(F.split("want", "/"), -1), "[.]json$", "").alias("module"))
    keyed = lambda rows, key: rows.groupBy(F.col(key).alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("n"))

    def answers(asked: DataFrame, want: str, rows: DataFrame, key: str, tier: str) -> DataFrame:
        found = asked.join(keyed(rows, key), F.col(want) == F.col("key")).groupBy("request_id").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
        return (found if tier in ("record", "exact") else found.filter("n = 1")).select("request_id", "id", F.lit(tier).alias("tier"))

    record = answers(record, "module", memories.select("id", T.module_name(F.col("name")).alias("module")), "module", "record")
    exact = answers(r, "want", f, "full", "exact")
    base = answers(r.filter("NOT contains(want, '/')"), "want", f, "base", "basename")
    parts = F.split("full", "/")
    ends = f.filter(F.size(parts) > 2).select("id", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("end"))
    suffix = answers(r.filter("contains(want, '/')"), "want", ends, "end", "suffix")
    found = record.unionByName(exact).unionByName(base).unionByName(suffix)
    order = F.when(F.col("tier") == "record", 0).when(F.col("tier") == "exact", 1).otherwise(2)
    best = found.groupBy("request_id").agg(F.min_by(F.struct("tier", "id"), order).alias("best"))
    return r.select("request_id").join(best, "request_id", "left").select("request_id", "best.tier", "best.id")
