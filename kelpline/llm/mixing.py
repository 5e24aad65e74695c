"""Mixing sources to target weights by pivotal dependent rounding; DataFrame and SQL operations only.

Every source takes a share of the mix (`source_targets`), so each of its documents should be taken `rate` times, from
0 to the cap. The whole part is given outright. The fractional parts are rounded by the pivotal method: two documents
meet, a random amount of word mass passes from one to the other, and one of them becomes 0 or 1 while the expectation
of both is kept. As the mass passed is counted in words, a source's taken words stay what they were, up to the last
document that remains fractional.

The pairings form a reduction tree: documents meet in groups of about FAN, every group leaves one fractional document,
and those meet again a level higher, until each source has one group. A hot source is many groups, none unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace, quoted

FAN = 64
WORD = r"[^\x20\x09-\x0D]+"

_ITEM = "struct<doc_id:bigint,source:string,size:bigint,m:bigint,w:double,p:double,r:double>"
_DONE = "array<struct<doc_id:bigint,source:string,size:bigint,m:bigint,x:int>>"


def word_count(text) -> F.Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, size) -> source, source_size, target, rate; one row per source, the null source last.

    Sources by code point take the weights in turn. Targets share `share` of all words by weight; one above
    cap * source_size stops there and its excess is reshared, until none is above. The set of stopped sources is
    the shortest prefix, by cap to weight ratio, after which no remaining source is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    # The first source, in this order, that its level doesn't fill sets the level of all after it.
    per = per.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every))
    target = F.coalesce(F.least(F.col("most"), F.col("water.level") * F.col("weight")), F.col("most"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select("source", "source_size", "n_rows", "target", rate.alias("rate"))


def _uniform(*cols) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def _fold(items: str) -> str:
    """SQL that lets the items of a group meet in turn; c is the one still fractional, d those that are done."""
    put = "concat(s.d, array(named_struct('doc_id', {0}.doc_id, 'source', {0}.source, 'size', {0}.size, 'm', {0}.m, 'x', {1})))"
    keep = "named_struct('doc_id', {0}.doc_id, 'source', {0}.source, 'size', {0}.size, 'm', {0}.m, 'w', {0}.w, 'p', {1}, 'r', {0}.r)"

    def pair(left: str, p: str, gone: str, x: int) -> str:
        return f"named_struct('c', {keep.format(left, p)}, 'd', {put.format(gone, x)})"

    return f"""aggregate({items}, named_struct('c', cast(null AS {_ITEM}), 'd', cast(array() AS {_DONE})), (s, e) ->
      if(s.c IS NULL, named_struct('c', e, 'd', s.d), element_at(transform(
        array(named_struct('up', least(s.c.w * (1 - s.c.p), e.w * e.p), 'down', least(s.c.w * s.c.p, e.w * (1 - e.p)))), t ->
        CASE WHEN e.r * (t.up + t.down) < t.down
          THEN if(s.c.w * (1 - s.c.p) <= e.w * e.p, {pair("e", "e.p - t.up / e.w", "s.c", 1)}, {pair("s.c", "s.c.p + t.up / s.c.w", "e", 0)})
          ELSE if(s.c.w * s.c.p <= e.w * (1 - e.p), {pair("e", "e.p + t.down / e.w", "s.c", 0)}, {pair("s.c", "s.c.p - t.down / s.c.w", "e", 1)}) END), 1)))"""


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, work: Workspace | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> one row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    copies is how often the mix takes the document (0 to cap), taken the words of those copies. Reruns agree, as
    the randomness is a hash of the row and `seed`.

    Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
    the last; rows that share doc_id, source and size are taken equally often; a null doc_id is a value like others.
    """
    work = work or Workspace(docs.sparkSession, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    alike = work.save(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "alike")
    sizes = alike.select("source", (F.col("size") * F.col("m")).alias("size"))
    targets = work.save(source_targets(sizes, weights, share, cap), "targets")
    same = alike["source"].eqNullSafe(targets["source"])
    rated = alike.join(targets, same).select("doc_id", alike["source"], "size", "m", "source_size", "n_rows", "target", "rate")
    rated = rated.withColumn("whole", F.floor("rate").cast("int"))

    most = targets.agg(F.max("n_rows")).first()[0] or 0
    part = F.col("rate") - F.floor("rate")
    open_ = rated.filter((F.col("size") > 0) & (part > 0)).select("doc_id", "source", "size", "m", (F.col("size") * F.col("m")).cast("double").alias("w"), part.alias("p"), "n_rows")
    done, level = [], 0
    while most:
        groups = F.ceil(F.col("n_rows") / FAN ** (level + 1)).cast("long")
        open_ = open_.withColumn("r", _uniform("doc_id", "source", "size", F.lit(seed), F.lit(2 * level)))
        open_ = open_.withColumn("group", F.pmod(F.xxhash64("doc_id", "source", "size", F.lit(seed), F.lit(2 * level + 1)), groups))
        item = F.struct("doc_id", "source", "size", "m", "w", "p", "r")
        met = open_.groupBy("source", "group").agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("n_rows").alias("n_rows"))
        met = work.save(met.select("n_rows", F.expr(_fold("items")).alias("s")), f"level-{level}")
        done.append(met.select(F.explode("s.d").alias("i")).select("i.*"))
        open_ = met.select("s.c.*", "n_rows").drop("r")
        level += 1
        if most <= FAN**level:
            break
    if most:
        last = F.when(_uniform("doc_id", "source", "size", F.lit(seed), F.lit(-1)) < F.col("p"), 1).otherwise(0)
        done.append(open_.select("doc_id", "source", "size", "m", last.alias("x")))
    rounded = rated.select("doc_id", "source", "size", "m", F.lit(0).alias("x")).limit(0)
    for d in done:
        rounded = rounded.union(d.select("doc_id", "source", "size", "m", "x"))

    r = rounded.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "x")
    on = F.col("doc_id").eqNullSafe(F.col("i")) & rated["source"].eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("x", F.lit(0))).otherwise(0)
    out = rated.join(r, on, "left").withColumn("copies", copies.cast("int"))
    out = out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as `mix_sources` takes it, with the columns of docs."""
    plan = mix_sources(docs, **options).select("doc_id", "source", "size", "copies").distinct().filter("copies > 0")
    own = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("source").cast("string").alias("s"), word_count(F.col("text")).alias("z"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    out = own.join(plan, F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
