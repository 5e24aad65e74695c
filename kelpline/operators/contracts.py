"""Contracts between routes and their consumers, from text alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import bound


def consumers(routes: DataFrame, files: DataFrame, pattern: str = r"""fetch\(\s*['"]([^'"]+)['"]""") -> DataFrame:
    """routes(route, file_path) x files(path, content) -> route, consumer: other files that fetch the route.

    Targets are extracted once and joined on equality, which replaces a search of every route in every file.
    """
    calls = files.select(F.col("path").alias("consumer"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("route")).distinct()
    return calls.join(routes, "route").filter("consumer <> file_path").select("route", "consumer")


def route_of(path):
    """The API route that a file's path declares, or null.

    Two layouts declare routes. Below a folder `app/api`, a file `route` handles the route of its folder; below a folder
    `pages/api`, a file handles the route of its own name, or of its folder if it is `index`. Files are JavaScript or
    TypeScript. The path is read segment by segment: where `api` follows either folder first, the route begins.
    """
    parts = F.split(F.translate(path, "\\", "/"), "/")
    name = F.element_at(parts, -1)
    dot = F.substring_index(name, ".", -1)
    stem = F.when(F.contains(name, F.lit(".")), name.substr(F.lit(1), F.length(name) - F.length(dot) - 1)).otherwise("")
    script = F.regexp_like(dot, F.lit("^[cm]?[jt]sx?$"))
    folders = F.slice(parts, 1, F.size(parts) - 1)

    def below(folder: str):
        """The folders under the first `folder`/api, or null."""
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(folders) - 1))
        at = F.filter(places, lambda i: (F.get(folders, i - 1) == folder) & (F.get(folders, i) == "api"))
        return F.when(F.size(at) > 0, F.slice(folders, F.get(at, 0) + 2, F.size(folders)))

    app, pages = below("app"), below("pages")
    route = F.when(script & (stem == "route") & (F.size(app) > 0), app)
    route = route.when(script & (F.size(pages) > 0) & (stem == "index"), pages).when(script & pages.isNotNull() & (stem != ""), F.concat(pages, F.array(stem)))
    return F.when(route.isNotNull(), F.concat(F.lit("/api/"), F.array_join(route, "/")))


#: A name, a number or a mark, with the blanks before it.
_NAME_OR_MARK = r"\s*(?:[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[^\sA-Za-z0-9_$])"


def response_keys(text):
    """Keys of the object literals that are passed to json(...), sorted, those of nested objects among them.

    The text is cut into names and marks once. One fold over them keeps the depth of braces since a json call's object began
    and the distinct keys; a name counts as a key where a colon follows it and a brace, a comma or a blank stands before it.
    """
    pieces = F.regexp_extract_all(text, F.lit(_NAME_OR_MARK), F.lit(0))
    cut = F.struct(pieces.alias("pieces"), F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+", "")).alias("marks"))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("keys"))

    def keys(c):
        def step(s, j):
            piece = F.get(c["marks"], j)
            opens = (piece == "{") & (F.get(c["marks"], j - 1) == "(") & (F.get(c["marks"], j - 2) == "json")
            depth = F.when(s["depth"] == 0, F.when(opens, 1).otherwise(0)).when(piece == "{", s["depth"] + 1).when(piece == "}", s["depth"] - 1).otherwise(s["depth"])
            named = (s["depth"] > 0) & F.regexp_like(piece, F.lit("^[A-Za-z_$]")) & (F.get(c["marks"], j + 1) == ":") & (F.get(c["marks"], j - 1).isin("{", ",") | (piece != F.get(c["pieces"], j)))
            return F.struct(depth.alias("depth"), F.when(named & ~F.array_contains(s["keys"], piece), F.array_append(s["keys"], piece)).otherwise(s["keys"]).alias("keys"))

        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(c["marks"]) - 1, F.lit(0))), start, step, lambda s: F.array_sort(s["keys"]))

    return F.when(text.isNotNull(), bound(cut, keys))


def barrel(path):
    """Whether a file only gathers others' exports, by its name."""
    low = F.lower(path)
    return low.endswith("/__init__.py") | low.endswith("/mod.rs") | F.regexp_like(low, F.lit(r"/index\.(?:ts|tsx|js|jsx|mts|mjs|cts|cjs)$"))
