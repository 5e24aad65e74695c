"""Snippets with marks: the shortest stretch of a text that has most of a query's words, those put in marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import tokens

#: Words and what stands between them; together they are the whole text.
PIECE = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"


def marked_snippets(hits: DataFrame, key: list[str], text: str, queries: DataFrame, pad: int = 8, left: str = "«", right: str = "»") -> DataFrame:
    """hits(query_id, key..., text, ...) -> (query_id, key..., covered, start, stop, snippet) of texts with a word of the query.

    covered is how many different words of the query the text has; start .. stop, in characters, the shortest stretch that
    has them all, the first of equals. The snippet shows it with `pad` pieces (words, or what stands between) on both
    sides, dots where the text goes on, and marks around every word of the query in it.

    Every word's last place is carried along to each hit, and the farthest back of them is where a stretch that ends here
    begins, so the work is hits times words of the query. hits are distinct by (query_id, key...), none of these null.
    """
    q = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("asked"))
    rows = hits.select("query_id", F.struct("query_id", *key).alias("of"), F.col(text).alias("text")).join(q, "query_id")
    pieces = rows.select("of", "asked", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(1))).alias("n", "piece"))
    upto, own = Window.partitionBy("of").orderBy("n"), Window.partitionBy("of")
    pieces = pieces.select("of", "n", "piece", (F.sum(F.length("piece")).over(upto) - F.length("piece")).cast("int").alias("at"), F.when(F.array_contains("asked", F.lower("piece")), F.lower("piece")).alias("word"))
    found = pieces.filter("word IS NOT NULL").select("of", "n", "at", F.length("piece").alias("size"), "word")
    present = found.groupBy("of").agg(F.collect_set("word").alias("present"))
    each = found.join(present, "of").select("of", "n", "at", "size", F.size("present").alias("covered"), "word", F.explode("present").alias("other"))
    last = F.last(F.when(F.col("word") == F.col("other"), F.struct("at", "n")), ignorenulls=True).over(Window.partitionBy("of", "other").orderBy("n"))
    ends = each.withColumn("last", last).groupBy("of", "n", "at", "size", "covered").agg(F.min("last").alias("from"), F.count("last").alias("have")).filter("have = covered")
    span = F.struct((F.col("at") + F.col("size") - F.col("from.at")).alias("length"), F.col("from.at").alias("start"), F.col("from.n").alias("first"), F.col("n").alias("until"))
    best = ends.groupBy("of", "covered").agg(F.min(span).alias("s"))
    shown = pieces.withColumn("end", F.max("n").over(own)).join(best, "of").filter(F.col("n").between(F.col("s.first") - pad, F.col("s.until") + pad))
    mark = F.when(F.col("word").isNotNull(), F.concat(F.lit(left), "piece", F.lit(right))).otherwise(F.col("piece"))
    out = shown.groupBy("of", "covered", "s", "end").agg(F.array_sort(F.collect_list(F.struct("n", mark.alias("p")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["p"]), "")
    whole = F.concat(F.when(F.col("s.first") - pad > 0, "...").otherwise(""), body, F.when(F.col("s.until") + pad < F.col("end"), "...").otherwise(""))
    return out.select("of.*", "covered", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.length")).cast("int").alias("stop"), whole.alias("snippet"))
