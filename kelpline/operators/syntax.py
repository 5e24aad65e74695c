"""Symbols and relations of TypeScript, JavaScript, Python, Go and Java sources, by joins and windows over their tokens.

The direct contents of a bracket are a stream; a declaration is a few neighbours in it and the next body. Members are
the stream of a class's body. What encloses what is a join of places with ranges in bins of BIN tokens, so that its work
follows tokens times nesting. Tokens are saved once and read by every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators import members
from kelpline.operators.lexer import token_table
from kelpline.sources.store import saved

BIN = 256
SCRIPT = ("typescript", "javascript")
# Words of the languages.
LISTED = ("async", "static", "public", "private", "protected", "abstract", "readonly")
MODIFIERS = (*LISTED, "export", "default", "declare", "override", "get", "set", "final", "synchronized", "native", "transient", "volatile", "strictfp")
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "yield", "new", "super", "else", "elif", "try", "finally", "with", "assert", "del", "do", "case", "func", "def", "class", "import", "throw", "print", "lambda", "in", "not", "and", "or", "go", "defer", "range", "select", "synchronized", "instanceof", "delete", "void", "raise", "except", "pass", "except")
NO_TYPE = ("new", "return", "throws", "extends", "implements", "package", "import", "throw", "else", "case", "assert", *MODIFIERS)


def _streams(tokens: DataFrame) -> DataFrame:
    """Code tokens with their neighbours p1..p3 and n1..n3 in the same bracket, the next body, semicolon and statement."""
    t = tokens.filter("kind <> 'comment'")
    by = Window.partitionBy("path", "up")
    # Rows are sorted once each way: what lies behind is found while they hold one neighbour, the others last.
    on, away = by.orderBy("i"), by.orderBy(F.desc("i"))
    near = F.struct("i", "kind", "text", "line", "end_line", "close")
    t = t.select("*", F.lag(near, 1).over(on).alias("p1"))
    fresh = F.col("p1").isNull() | (F.col("line") > F.col("p1.end_line"))
    script = F.col("language").isin(*SCRIPT, "java")
    start = F.col("p1").isNull() | (F.col("p1.text") == ";") | F.when(script, (F.col("p1.kind") == "open") | F.col("p1.text").isin(*MODIFIERS) | (fresh & (F.col("p1.kind") != "punct"))).otherwise(fresh)
    t = t.withColumn("fresh", fresh).withColumn("starts", start)
    begins = F.col("p1").isNull() | (F.col("p1.text") == ";") | (F.col("p1.kind") == "open") | (F.col("fresh") & (F.col("p1.kind") != "punct") & ~F.col("p1.text").startswith("@") & ~F.col("p1.text").isin(*MODIFIERS))
    t = t.select("*", F.last(F.when(begins, F.col("line")), ignorenulls=True).over(on).alias("statement_line"), F.max(F.greatest(F.col("i") + 1, "close")).over(by).alias("stream_end"), F.max("end_line").over(by).alias("last_line"))

    def following(which: Column, what: Column) -> Column:
        return F.last(F.when(which, what), ignorenulls=True).over(away.rowsBetween(Window.unboundedPreceding, -1))

    opens = F.col("kind") == "open"
    return t.select(
        "*", following(opens & F.col("text").isin("{", "INDENT"), F.struct("i", "close", "end_line")).alias("body"), following(opens & (F.col("text") == "("), F.struct("i", "close", "end_line")).alias("round"),
        following(F.col("text") == ";", F.col("i")).alias("semi"), following(F.col("fresh"), F.struct("i", F.col("p1.end_line").alias("before"))).alias("next_line"), following(F.col("starts"), F.struct("i", F.col("p1.end_line").alias("before"))).alias("next_start"),
        *(F.lead(near, k).over(away).alias(f"p{k}") for k in (2, 3)), *(F.lag(near, k).over(away).alias(f"n{k}") for k in (1, 2, 3)),
    )


def _modified() -> tuple[Column, Column, Column]:
    """(modifiers before a token in order, line of the first of them, whether one is `export`)."""
    flags, ok = [], F.lit(True)
    for k in (1, 2, 3):
        ok = ok & F.coalesce(F.col(f"p{k}.text").isin(*MODIFIERS), F.lit(False))
        flags.append(ok)
    words = F.filter(F.array(*(F.when(f, F.col(f"p{k}.text")) for k, f in reversed(list(enumerate(flags, 1))))), lambda w: w.isin(*LISTED))
    line = F.col("line")
    for k, f in enumerate(flags, 1):
        line = F.when(f & F.col(f"p{k}.text").isin(*LISTED), F.col(f"p{k}.line")).otherwise(line)
    exported = F.lit(False)
    for k, f in enumerate(flags, 1):
        exported = exported | (f & (F.col(f"p{k}.text") == "export"))
    return words, line, exported


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df saved, and joined by sorting: it grows with the sources, and Spark's size check would take its files, a twentieth of its rows, for its size."""
    return saved(df, name).hint("merge")


def within(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (path, at, ...) with the ranges (path, first, last, ...) that hold them strictly: one row a pair, equi-joined by bins."""
    cut = ranges.withColumn("bin", F.explode(F.sequence(F.expr(f"first div {BIN}"), F.expr(f"last div {BIN}"))))
    return points.withColumn("bin", F.expr(f"at div {BIN}")).join(cut, ["path", "bin"]).filter("first < at AND at < last").drop("bin")


def _declarations(t: DataFrame) -> DataFrame:
    """Classes, interfaces and functions that a keyword begins: path, language, at, name, type, last, line, end_line, params, modifiers, exported, body, owner."""
    words, first_line, export = _modified()
    script, python, go = F.col("language").isin(*SCRIPT), F.col("language") == "python", F.col("language") == "go"
    text, n1 = F.col("text"), F.col("n1")
    named = n1["kind"] == "word"
    like = text.isin("class", "interface") & (script | (F.col("language") == "java")) & named & ~n1["text"].isin("extends", "implements") & F.coalesce(F.col("p1.text") != ".", F.lit(True))
    star = (n1["text"] == "*") & (F.col("n2.kind") == "word")
    function = script & (text == "function") & (named | star) & F.col("starts")
    defined = python & text.isin("class", "def") & named & (F.col("starts") | (F.col("p1.text") == "async"))
    func = go & (text == "func") & (F.col("up") == -1) & named & (F.col("n2.text") == "(")
    method = go & (text == "func") & (F.col("up") == -1) & (n1["text"] == "(") & (F.col("n2.kind") == "word") & (F.col("n3.text") == "(")
    struct = go & (text == "struct") & (F.col("p1.kind") == "word") & (n1["text"] == "{") & ((F.col("p2.text") == "type") | (F.col("around") == "("))
    kind = F.when(like & (text == "class") | struct | python & (text == "class"), "Class").when(like, "Interface").when(method, "Method").otherwise("Function")
    name = F.when(struct, F.col("p1.text")).when(method | function & star, F.col("n2.text")).otherwise(n1["text"])
    params = F.when(method, F.col("n3.i")).when(function | defined & (text == "def") | func, F.col("round.i"))
    own = F.when(python, F.col("body.i") == F.col("next_line.i")).otherwise(F.col("semi").isNull() | (F.col("body.i") < F.col("semi")))
    body = F.when(own, F.col("body"))
    rows = t.filter("kind = 'word'").filter(like | function | defined | func | method | struct).filter(python | body.isNotNull())
    last = F.coalesce(body["close"], F.col("next_line.i"), F.col("stream_end"))
    end = F.coalesce(body["end_line"], F.col("next_line.before"), F.col("last_line"))
    no = F.array().cast("array<string>")
    return rows.select(
        "path", "language", F.col("i").alias("at"), name.alias("name"), kind.alias("type"), last.alias("last"), F.when(script, first_line).when(struct, F.col("p1.line")).when(F.col("language") == "java", F.col("statement_line")).otherwise(F.col("line")).alias("line"), end.alias("end_line"), params.alias("params"),
        F.when(script, words).otherwise(no).alias("modifiers"), (export & script).alias("export"), body["i"].alias("body"), F.when(method, n1["i"]).alias("receiver"),
    )


def _members(t: DataFrame, owners: DataFrame) -> DataFrame:
    """Methods and properties in the bodies of owners (path, at, type, body), as `_declarations` gives them."""
    words, first_line, _ = _modified()
    script, java, go, python = F.col("language").isin(*SCRIPT), F.col("language") == "java", F.col("language") == "go", F.col("language") == "python"
    text, n1, p1 = F.col("text"), F.col("n1"), F.col("p1")
    o = owners.filter("type IN ('Class', 'Interface') AND body IS NOT NULL").select("path", F.col("body").alias("up"))
    s = t.filter("kind = 'word'").join(o, ["path", "up"]).filter(~text.isin(*KEYWORDS))
    calls = n1["text"] == "("
    ends = n1.isNull() | (n1["line"] > F.col("end_line"))
    typed = F.coalesce((p1["kind"] == "word") & ~p1["text"].isin(*NO_TYPE) | p1["text"].isin(">", "]"), F.lit(False))
    method = script & F.col("starts") & calls | java & typed & calls
    field = (
        script & F.col("starts") & (n1["text"].isin(":", "=", ";", "?", "!") | ends) & ~(text.isin(*MODIFIERS) & ends & n1.isNotNull())
        | java & typed & n1["text"].isin("=", ";", ",")
        | go & F.col("fresh") & ~ends & ~n1["text"].isin(".", ";") & (n1["kind"] != "string")
        | python & F.col("starts") & n1["text"].isin("=", ":")
    )
    row_end = F.when(script | java, F.struct(F.col("next_start.i").alias("i"), F.col("next_start.before").alias("before"))).otherwise(F.struct(F.col("next_line.i").alias("i"), F.col("next_line.before").alias("before")))
    stop = F.when(script | java, F.least(F.col("semi"), row_end["i"])).otherwise(row_end["i"])  # a statement ends at its semicolon or where the next begins
    body = F.when(method & (stop.isNull() | (F.col("body.i") < F.coalesce("semi", F.lit(1 << 30)))), F.col("body"))
    end = F.coalesce(body["end_line"], F.when(F.col("semi") < row_end["i"], F.col("line")).otherwise(row_end["before"]), F.when(F.col("semi").isNull(), F.col("last_line")), F.greatest(F.col("line"), n1["end_line"]))
    return s.filter(method | field).select(
        "path", "language", F.col("i").alias("at"), F.col("text").alias("name"), F.when(method, "Method").otherwise("Variable").alias("type"), F.coalesce(body["close"], stop, F.col("stream_end")).alias("last"),
        F.when(script, first_line).when(java, F.col("statement_line")).otherwise(F.col("line")).alias("line"), F.greatest(end, F.col("line")).alias("end_line"), F.when(method, n1["i"]).alias("params"), F.when(script, words).otherwise(F.array().cast("array<string>")).alias("modifiers"),
        F.lit(False).alias("export"), body["i"].alias("body"), F.lit(None).cast("int").alias("receiver"),
    )


def _parameters(tokens: DataFrame, brackets: DataFrame) -> DataFrame:
    """(path, params, n): parameters in each bracket (path, params), by what stands between commas at its level."""
    s = tokens.filter("kind <> 'comment'").join(brackets.select("path", F.col("params").alias("up")).distinct(), ["path", "up"])
    part = F.sum((F.col("text") == ",").cast("int")).over(Window.partitionBy("path", "up").orderBy("i"))
    parts = s.withColumn("part", part).filter("text <> ','").groupBy("path", "language", "up", "part").agg(F.count("*").alias("n"), F.min_by("text", "i").alias("first"), F.max((F.col("text") == "=").cast("int")).alias("set"))
    counted = F.when(F.col("language") == "python", F.sum(((F.col("n") == 1) & ~F.col("first").isin("self", "cls")).cast("int"))).when(F.col("language") == "go", F.when(F.max("n") > 1, F.sum((F.col("n") > 1).cast("int"))).otherwise(F.count("*"))).otherwise(F.count("*"))
    return parts.groupBy("path", F.col("up").alias("params"), "language").agg(counted.cast("int").alias("n")).drop("language")


def symbols_of(tokens: DataFrame) -> DataFrame:
    """tokens -> id, name, type, file_path, language, start_line, end_line, modifiers, parent_id, exported, first, last.

    first and last are the range of a symbol's tokens. Ids are language:path:owner:name:parameters:start line:end line.
    """
    t = _kept(_streams(tokens).filter("kind = 'word'"), "streams")  # declarations and members begin at a word
    found = _kept(_declarations(t), "declarations")
    found = _kept(found.unionByName(_members(t, found)), "found")
    script, python = F.col("language").isin(*SCRIPT), F.col("language") == "python"
    counts = _parameters(tokens, found.filter("params IS NOT NULL"))
    receivers = tokens.filter("kind = 'word'").join(found.filter("receiver IS NOT NULL").select("path", F.col("receiver").alias("up")), ["path", "up"]).groupBy("path", F.col("up").alias("receiver")).agg(F.max_by("text", "i").alias("of")).hint("merge")
    rows = found.join(counts, ["path", "params"], "left").join(receivers, ["path", "receiver"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    holders = found.filter("type <> 'Variable'").select("path", F.col("at").alias("first"), "last", F.col("name").alias("owner"), F.col("type").alias("owner_type"), F.col("export").alias("outer"))
    held = within(rows.select("path", "at"), holders).groupBy("path", "at").agg(F.max_by(F.struct(F.col("first").alias("at"), "owner", "owner_type"), "first").alias("holder"), F.max("outer").alias("outer")).hint("merge")
    rows = rows.join(held, ["path", "at"], "left")
    # Go's methods belong to the struct of the receiver's type, wherever it stands; Java's and Go's classes to nobody.
    struct = Window.partitionBy("path", "name").orderBy(F.desc("at"))
    structs = found.filter("language = 'go' AND type = 'Class'").withColumn("k", F.row_number().over(struct)).filter("k = 1").select("path", F.col("name").alias("of"), F.struct("at", F.col("name").alias("owner"), F.col("type").alias("owner_type")).alias("struct"))
    rows = rows.join(structs, ["path", "of"], "left")
    own = F.when(F.col("receiver").isNotNull(), F.col("struct")).when(script | python | F.col("type").isin("Method", "Variable"), F.col("holder"))
    kind = F.when(python & (F.col("type") == "Function") & (own["owner_type"] == "Class"), "Method").otherwise(F.col("type"))
    owner = F.coalesce(own["owner"], F.when(F.col("receiver").isNotNull(), F.col("of")), F.lit("root"))
    rows = rows.withColumn("parent_at", own["at"]).withColumn("type", kind).withColumn("id", F.concat_ws(":", "language", "path", owner, "name", "n", "line", "end_line"))
    parents = rows.select("path", F.col("at").alias("parent_at"), F.col("id").alias("parent_id"), F.col("name").alias("parent")).hint("merge")
    exported = F.when(script, F.col("export") | F.coalesce("outer", F.lit(False))).when(python & (F.col("type") == "Variable"), ~F.col("parent").startswith("_")).when(python, ~F.col("name").startswith("_")).otherwise(F.col("name").rlike("^[A-Z]"))
    return rows.join(parents, ["path", "parent_at"], "left").select(
        "id", "name", "type", F.col("path").alias("file_path"), "language", F.col("line").alias("start_line"), "end_line", "modifiers", "parent_id", exported.alias("exported"), F.col("at").alias("first"), "last", "body", "params",
    )


def imports_of(tokens: DataFrame) -> DataFrame:
    """(file_path, language, source, binding) of every import statement, once each."""
    t = tokens.filter("kind <> 'comment'")
    keyed = t.filter("up = -1")
    by = Window.partitionBy("path").orderBy("i")
    fresh = F.lag("end_line").over(by).isNull() | (F.col("line") > F.lag("end_line").over(by)) | (F.lag("text").over(by) == ";")
    head = (F.col("kind") == "word") & F.col("text").isin("import", "from") & (fresh | (F.col("language") == "java"))
    statement = F.sum(F.when(F.col("language").isin("python", "go"), fresh.cast("int")).otherwise((fresh & (F.col("kind") == "word")).cast("int"))).over(by)
    lines = keyed.withColumn("head", head & fresh).withColumn("statement", statement)
    of = lines.filter("head").select("path", "statement", F.col("text").alias("verb"))
    whole = lines.join(of, ["path", "statement"]).select("path", "language", "statement", "verb", "i", "kind", "text")
    inner = t.filter("up <> -1").select("path", F.col("up").alias("open"), "i", "kind", "text", "line")
    deep = whole.filter("kind = 'open'").select("path", "language", "statement", "verb", F.col("i").alias("open")).join(inner, ["path", "open"])
    parts = whole.withColumn("line", F.lit(0)).unionByName(deep.select("path", "language", "statement", "verb", "i", "kind", "text", "line")).filter("text NOT IN ('(', ')', '{')")
    words = parts.groupBy("path", "language", "statement", "verb").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "text", "line"))).alias("w"))

    def quoted(x: Column) -> Column:
        return F.regexp_replace(x, "^['\"`]|['\"`]$", "")

    def pieces(w: Column, sep: Column) -> Column:
        """Texts of the words of `w`, a space apart, cut at sep."""
        return F.filter(F.transform(F.split(F.array_join(F.transform(w, lambda x: x["text"]), " "), sep), lambda x: F.trim(x)), lambda x: x != "")

    def dots(x: Column) -> Column:
        return F.regexp_replace(x, r" ?\. ?", ".")

    last = lambda x, sep: F.element_at(F.split(x, sep), -1)
    empty = F.array().cast("array<struct<source:string,binding:string>>")
    pair = lambda s, b: F.struct(s.alias("source"), b.alias("binding"))
    alias = lambda x: F.when(x.contains(" as "), last(x, " as ")).otherwise(last(dots(x), r"\."))
    strings = F.filter("w", lambda x: x["kind"] == "string")
    source = quoted(F.element_at(strings, -1)["text"])
    clause = F.filter("w", lambda x: (x["kind"] != "string") & ~x["text"].isin("import", "from", "type", ";"))
    script = F.when((F.size(strings) > 0) & (F.col("verb") == "import"), F.transform(pieces(clause, F.lit(",")), lambda x: pair(source, alias(x)))).otherwise(empty)
    rest = F.filter("w", lambda x: ~x["text"].isin("import", ";"))
    java = F.transform(pieces(F.filter(rest, lambda x: x["text"] != "static"), F.lit(";")), lambda x: pair(dots(x), last(dots(x), r"\.")))
    plain = F.transform(pieces(rest, F.lit(",")), lambda x: pair(dots(F.substring_index(x, " as ", 1)), alias(x)))
    python_from = F.array_join(F.transform("w", lambda x: x["text"]), " ")
    module = dots(F.trim(F.regexp_extract(python_from, r"^from (.*?) import\b", 1)))
    names = F.filter(F.transform(F.split(F.regexp_extract(python_from, r"\bimport\b(.*)$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    python = F.when(F.col("verb") == "from", F.transform(names, lambda x: pair(module, alias(x)))).otherwise(plain)
    # Go: a string is an import; the word before it on its line, if any, is its name.
    go = F.transform(F.filter(F.transform("w", lambda x, k: F.struct(x.alias("x"), F.when(k > 0, F.get("w", k - 1)).alias("p"))), lambda z: z["x"]["kind"] == "string"), lambda z: pair(quoted(z["x"]["text"]), F.when((z["p"]["kind"] == "word") & (z["p"]["text"] != "import") & (z["p"]["line"] == z["x"]["line"]), z["p"]["text"]).otherwise(last(quoted(z["x"]["text"]), "/"))))
    all_ = F.when(F.col("language").isin(*SCRIPT), script).when(F.col("language") == "java", java).when(F.col("language") == "go", go).otherwise(python)
    return words.select(F.col("path").alias("file_path"), "language", F.explode(all_).alias("b")).select("file_path", "language", "b.source", "b.binding").filter("source <> ''").distinct()


def heritage_of(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(owner_id, relation, base): the names after extends and implements, and in the brackets of a Python class."""
    heads = symbols.filter("type IN ('Class', 'Interface') AND body IS NOT NULL")
    t = tokens.filter("kind <> 'comment'")
    near = heads.select("id", F.col("file_path").alias("path"), "language", "type", "first", F.col("body").alias("last"))
    own = within(t.withColumn("at", F.col("i")).drop("language", "last"), near).filter("language <> 'go'")
    by = Window.partitionBy("id").orderBy("i")
    level = F.min("up").over(Window.partitionBy("id"))
    marks = F.col("text").isin("extends", "implements") & (F.col("kind") == "word")
    depth = F.sum(F.when(F.col("text") == "<", 1).when(F.lag("text").over(by) == ">", -1).otherwise(0)).over(by)
    rows = own.withColumn("level", level).withColumn("angle", depth).withColumn("before", F.lag("text").over(by)).withColumn("verb", F.last(F.when(marks & (F.col("angle") == 0), F.col("text")), ignorenulls=True).over(by))
    listed = rows.filter("language <> 'python' AND up = level AND kind = 'word' AND angle = 0 AND verb IS NOT NULL AND text NOT IN ('extends', 'implements') AND (before IN ('extends', 'implements', ','))")
    listed = listed.filter("type = 'Class'").select(F.col("id").alias("owner_id"), F.when(F.col("verb") == "extends", "EXTENDS").otherwise("IMPLEMENTS").alias("relation"), F.col("text").alias("base"))
    after = F.lead("text").over(by)
    bases = rows.withColumn("after", after).filter("language = 'python' AND up > level AND around = '(' AND kind = 'word'").withColumn("bracket", F.min("up").over(Window.partitionBy("id"))).filter("up = bracket AND (before IN ('(', ',')) AND (after = ',' OR after = ':')")
    return listed.union(bases.select(F.col("id").alias("owner_id"), F.lit("EXTENDS").alias("relation"), F.col("text").alias("base"))).distinct()


def calls_of(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, file_path, language, callee, line): a name before a round bracket, for every function and method around it; not in declarations and after `new`."""
    by = Window.partitionBy("path", "up").orderBy("i")
    t = tokens.filter("kind <> 'comment'").select("*", F.lead("text").over(by).alias("after"), F.lag("text").over(by).alias("before"))
    places = t.filter("kind = 'word' AND after = '('").filter(~F.col("text").isin(*KEYWORDS)).filter("before IS NULL OR before NOT IN ('new', 'function', 'def', 'func', 'class')")
    heads = symbols.filter("params IS NOT NULL").select(F.col("file_path").alias("path"), (F.col("params") - 1).alias("i"))
    places = places.join(heads, ["path", "i"], "left_anti").select("path", F.col("i").alias("at"), F.col("text").alias("callee"), "line")
    around = symbols.filter("type IN ('Function', 'Method')").select(F.col("file_path").alias("path"), "language", F.col("id").alias("from_id"), F.coalesce("params", "first").alias("first"), "last")
    return within(places, around).select("from_id", F.col("path").alias("file_path"), "language", "callee", "line").distinct()


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of a name go to the first symbol of that name in the file (1.0), else outside (0.5)."""
    first = symbols.groupBy("file_path", F.col("name").alias("callee")).agg(F.min_by("id", "first").alias("target"))
    away = F.concat_ws(":", F.lit("external"), "language", "file_path", F.lit("call"), "callee")
    rows = calls.select("from_id", "file_path", "language", "callee").distinct().join(first, ["file_path", "callee"], "left")
    return rows.select("from_id", F.coalesce("target", away).alias("to_id"), F.lit("CALLS").alias("type"), F.when(F.col("target").isNull(), 0.5).otherwise(1.0).alias("confidence")).distinct()


def uses_of(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, name, mode): this.name, self.name or the receiver's name in functions and methods; write where it is assigned whole."""
    by = Window.partitionBy("path", "up").orderBy("i")
    t = tokens.filter("kind <> 'comment'").select("*", *(F.lag("text", k).over(by).alias(f"p{k}") for k in (1, 2)), F.lag("text", 3).over(by).alias("p3"), F.lead("text").over(by).alias("after"))
    t = t.filter("kind = 'word' AND p1 = '.' AND (p3 IS NULL OR p3 <> '.')")
    around = symbols.filter("type IN ('Function', 'Method')").select(F.col("file_path").alias("path"), "language", F.col("id").alias("from_id"), "first", "last")
    receivers = tokens.filter("kind = 'word'").join(symbols.filter("language = 'go' AND type = 'Method'").select(F.col("file_path").alias("path"), (F.col("first") + 1).alias("up"), F.col("id").alias("from_id")), ["path", "up"]).groupBy("from_id").agg(F.min_by("text", "i").alias("receiver")).hint("merge")
    rows = within(t.select("path", F.col("i").alias("at"), "text", "p2", "after"), around).join(receivers, "from_id", "left")
    this = F.when(F.col("language") == "python", "self").when(F.col("language") == "go", F.col("receiver")).otherwise(F.lit("this"))
    return rows.filter(F.col("p2") == this).select("from_id", F.col("text").alias("name"), F.when(F.col("after") == "=", "write").otherwise("read").alias("mode")).distinct()


def _found(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The code tokens of files and the symbols among them, both saved."""
    tokens = _kept(token_table(files).filter("kind <> 'comment'").drop("start", "stop"), "tokens")
    return tokens, _kept(symbols_of(tokens), "symbols")


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of `extract` alone; nothing that relations need is made."""
    return _found(files)[1]


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, language, content) -> (symbols, relations(from_id, to_id, type, confidence, reason)).

    Relations are HAS_METHOD, HAS_PROPERTY, IMPORTS, EXTENDS, IMPLEMENTS, METHOD_OVERRIDES, METHOD_IMPLEMENTS, ACCESSES
    and CALLS. Bases within the file are looked up for TypeScript and JavaScript only. A path stands for one file; other
    languages, null and empty sources have no rows.
    """
    tokens, symbols = _found(files)
    none = F.lit(None).cast("string")
    owners = symbols.select(F.col("id").alias("parent_id"), F.col("type").alias("owner_type"))
    has = symbols.filter("type IN ('Method', 'Variable')").join(owners, "parent_id").filter("owner_type = 'Class' OR (type = 'Variable' OR language = 'java') AND owner_type = 'Interface'")
    has = has.select(F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"), F.when(F.col("type") == "Method", "HAS_METHOD").otherwise("HAS_PROPERTY").alias("type"), F.lit(1.0).alias("confidence"), none.alias("reason"))
    heritage = _kept(heritage_of(tokens, symbols), "heritage")
    known = symbols.withColumn("name", F.when(F.col("language").isin(*SCRIPT), F.col("name")))
    up = members.heritage_edges(known, heritage).select("*", F.when((F.col("confidence") > 0.9) & F.col("type").isin("EXTENDS", "IMPLEMENTS"), "same-file").alias("reason"))
    bound = members.import_edges(symbols, _kept(imports_of(tokens), "imports"))
    access = members.access_edges(symbols, _kept(uses_of(tokens, symbols), "uses"))
    calls = call_edges(_kept(calls_of(tokens, symbols), "calls"), symbols).withColumn("reason", none)
    return symbols, has.unionByName(bound).unionByName(up).unionByName(access).unionByName(calls)
