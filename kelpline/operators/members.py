"""Edges of symbols through what owns them: imports, heritage, overrides, property accesses, receiver types, members.

symbols: (id, name, type, file_path, language, exported, parent_id, start_line); parent_id is the owner's id, or null at
the top of a file. All are equi joins on a file, an owner or a name, so a task holds rows of its own keys only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def import_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """imports(file_path, source, binding): every top-level symbol of a file imports each of its bindings; equal edges once."""
    to = F.concat_ws(":", F.lit("external"), "language", "file_path", F.lit("import"), "source", "binding")
    top = symbols.filter("parent_id IS NULL").select(F.col("id").alias("from_id"), "file_path", "language")
    both = top.join(imports.select("file_path", "source", "binding").distinct(), "file_path")
    return both.select("from_id", to.alias("to_id"), F.lit("IMPORTS").alias("type"), F.lit(0.6).alias("confidence"), F.col("source").alias("reason")).distinct()


def heritage_edges(symbols: DataFrame, heritage: DataFrame) -> DataFrame:
    """heritage(owner_id, relation, base): EXTENDS or IMPLEMENTS edges and the method edges that follow from them.

    A base is the first symbol of its name in the owner's file (0.95), else external (0.7). A method of the owner
    overrides or implements the last method of its name that a base of the same file has (0.9).
    """
    first = symbols.groupBy("file_path", F.col("name").alias("base")).agg(F.min_by("id", F.struct("start_line", "id")).alias("base_id"))
    owner = symbols.select(F.col("id").alias("owner_id"), "file_path", "language")
    known = heritage.distinct().join(owner, "owner_id").join(first, ["file_path", "base"], "left")
    away = F.concat_ws(":", F.lit("external"), "language", "file_path", F.lower("relation"), "base")
    up = known.select(F.col("owner_id").alias("from_id"), F.coalesce("base_id", away).alias("to_id"), F.col("relation").alias("type"), F.when(F.col("base_id").isNull(), 0.7).otherwise(0.95).alias("confidence"))
    methods = symbols.filter("type = 'Method' AND parent_id IS NOT NULL")
    own = methods.select(F.col("id").alias("from_id"), "name", F.col("parent_id").alias("owner_id"))
    last = methods.groupBy(F.col("parent_id").alias("base_id"), "name").agg(F.max_by("id", F.struct("start_line", "id")).alias("to_id"))
    kind = F.when(F.col("relation") == "EXTENDS", "METHOD_OVERRIDES").otherwise("METHOD_IMPLEMENTS")
    matched = known.filter("base_id IS NOT NULL").join(own, "owner_id").join(last, ["base_id", "name"])
    return up.union(matched.select("from_id", "to_id", kind.alias("type"), F.lit(0.9).alias("confidence"))).distinct()


def access_edges(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """uses(from_id, name, mode): reads and writes of a property of the user's own owner (0.8); equal edges once."""
    user = symbols.filter("parent_id IS NOT NULL").select(F.col("id").alias("from_id"), "parent_id")
    last = symbols.filter("type = 'Variable'").groupBy("parent_id", "name").agg(F.max_by("id", F.struct("start_line", "id")).alias("to_id"))
    found = uses.select("from_id", "name", "mode").distinct().join(user, "from_id").join(last, ["parent_id", "name"])
    return found.select("from_id", "to_id", F.lit("ACCESSES").alias("type"), F.lit(0.8).alias("confidence"), F.concat_ws(":", "mode", "name").alias("reason"))


def receiver_types(scopes: DataFrame, properties: DataFrame, facts: DataFrame, returns: DataFrame) -> DataFrame:
    """-> (scope_id, key, type_name): what each name of a function's body is known to hold at its end.

    scopes(scope_id, owner_id, file_path); properties(owner_id, name, type_name, constructed): what a constructor assigns
    goes over a declaration. facts(scope_id, position, key, type_name, callee, value): a declared type, else what the
    called function of the file returns, else the type that the assigned name has by then; later facts go over earlier
    ones, a fact without a type changes nothing. returns(file_path, callee, type_name), one row a function.

    Facts of one position go by key, type and value, nulls first. A scope's facts are folded in order into a map, in one row: a function body bounds it.
    """
    best = properties.groupBy("owner_id", "name").agg(F.max_by("type_name", F.struct("constructed", "type_name")).alias("type_name"))
    this = scopes.join(best, "owner_id").select("scope_id", F.lit(-1).cast("long").alias("position"), F.concat(F.lit("this."), "name").alias("key"), "type_name", F.lit(None).cast("string").alias("value"))
    typed = facts.join(scopes.select("scope_id", "file_path"), "scope_id").join(returns.withColumnRenamed("type_name", "returned"), ["file_path", "callee"], "left")
    typed = typed.select("scope_id", F.col("position").cast("long").alias("position"), "key", F.coalesce("type_name", "returned").alias("type_name"), "value")
    rows = this.union(typed).groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("position", "key", "type_name", "value"))).alias("rows"))

    def step(known, fact):
        held = F.coalesce(fact["type_name"], F.element_at(known, fact["value"]))
        rest = F.map_filter(known, lambda k, _: k != fact["key"])
        return F.when(held.isNull(), known).otherwise(F.map_concat(rest, F.create_map(fact["key"], held)))

    known = F.aggregate("rows", F.create_map().cast("map<string,string>"), step)
    return rows.select("scope_id", F.explode(known).alias("key", "type_name"))


def find_members(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests(request_id, owner, member, file_path, language) -> (request_id, owner_id, member_id): at most one each.

    A method or function whose parent is the named owner; file_path and language bind where they are not null. Exported
    owners go first, then files by name, then the earlier member. What a request can ask for (a name, in a file, in a
    language, in both) has its one answer found once, so a request meets one row, not all owners of the name.
    """
    o = symbols.select(F.col("id").alias("owner_id"), F.col("name").alias("owner"), F.col("file_path").alias("file"), F.col("language").alias("lang"), F.col("exported").alias("open"))
    m = symbols.filter("type IN ('Method', 'Function') AND parent_id IS NOT NULL").select(F.col("id").alias("member_id"), F.col("name").alias("member"), F.col("parent_id").alias("owner_id"), "start_line")
    shut = F.when(F.col("open"), 0).when(~F.col("open"), 1).otherwise(2)
    best = F.struct(shut.alias("shut"), "file", "start_line", "member_id", "owner_id")
    asked = F.explode(F.array(*(F.struct(F.lit(f).alias("in_file"), F.lit(g).alias("in_lang")) for f in (False, True) for g in (False, True))))
    bound = lambda flag, c: F.when(F.col(flag), F.col(c))
    ways = o.join(m, "owner_id").select("owner", "member", "file", "lang", best.alias("best"), asked.alias("asked")).select("*", "asked.*")
    ways = ways.filter("(NOT in_file OR file IS NOT NULL) AND (NOT in_lang OR lang IS NOT NULL)")
    answers = ways.groupBy("owner", "member", bound("in_file", "file").alias("of_file"), bound("in_lang", "lang").alias("of_lang")).agg(F.min("best").alias("best"))
    same = F.col("of_file").eqNullSafe(F.col("file_path")) & F.col("of_lang").eqNullSafe(F.col("language"))
    r = requests.select("request_id", F.col("owner").alias("o"), F.col("member").alias("m"), "file_path", "language")
    found = r.join(answers, (F.col("o") == F.col("owner")) & (F.col("m") == F.col("member")) & same)
    return found.groupBy("request_id").agg(F.min("best").alias("best")).select("request_id", "best.owner_id", "best.member_id")
