"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by style path (element names with their classes). A leaf style node's content
importance is the entropy of its texts over the host's pages, relative to the most it could be: text that every page
repeats has none, text that is new on every page has all. An element's presentation importance is likewise the entropy
of its child sequences. A branch counts g^l of its content and 1 - g^l of its parent's presentation, l being the
parent's different child sequences, plus what its markup says outright (an article's prose, a menu, an advert). Branches
of low importance are cut from every page of the host. Copies of a page (equal branches and texts) count as one, and a
page that would lose all its text keeps its most important branch that no markup calls boilerplate.

The tree is a distributed table of (host, path, value) counts. A hot host is just more values: nothing gathers its pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.html import PROSE, Block, blocks, key
from kelpline.llm.store import Workspace, tidy

#: Least importance kept; weight of content per different child sequence; pages that a host needs for its own evidence.
LEAST, GAMMA, FEW = 0.5, 0.9, 8
#: What markup adds to a branch: explicit boilerplate, prose within main content, and text outside a page's main content.
NOISE, PROSE_WITHIN, OUTSIDE = -2.0, 0.5, -0.6
#: Cut branches that a task may hold as a dict (some 200 bytes each); beyond that they are joined to the pages by host.
HELD = 1 << 18
#: Stands for the importance of a branch that is not cut.
KEPT = float("inf")

SEEN = "host long, path long, parent long, prior double, value long, page long"


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _named(page: list[Block]) -> Iterator[tuple[Block, str, float]]:
    """Blocks with the key text of their branch and what their markup adds to its importance."""
    within = any(b.main and not b.noise for b in page)
    for b in page:
        if b.noise:
            prior = NOISE
        elif within and not b.main:
            prior = OUTSIDE
        else:
            prior = PROSE_WITHIN if b.main and b.tag in PROSE else 0.0
        yield b, f"{within:d}{b.path}", prior


@tidy
def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host, seen = key(host_of(url)), set()
            page, children = blocks(source)
            named = list(_named(page))
            whole = key(*(x for b, name, _ in named for x in (name, b.text)))
            for b, name, prior in named:
                seen.add((host, key(name), key("e", b.parent), prior, key(b.text), whole))
            for path, runs in children.items():
                seen.add((host, key("e", path), None, None, key(*runs), whole))
            rows += seen
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "path", "parent", "prior", "value", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) -> host, path, importance of every text branch of every host (64-bit keys)."""
    seen = pages.select("url", "html").mapInArrow(_observe, SEEN)
    values = seen.groupBy("host", "path", "value").agg(F.count_distinct("page").alias("n"), F.min("parent").alias("parent"), F.min("prior").alias("prior"))
    n = F.sum("n")
    entropy = F.when(n > 1, (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)).otherwise(1.0)
    nodes = values.groupBy("host", "path").agg(n.alias("pages"), entropy.alias("entropy"), F.count("*").alias("kinds"), F.min("parent").alias("parent"), F.min("prior").alias("prior"))
    above = nodes.filter("parent is null").select("host", F.col("path").alias("parent"), F.col("entropy").alias("shape"), F.col("kinds").alias("l"))
    joined = nodes.filter("parent is not null").join(above, ["host", "parent"], "left")
    content = F.pow(F.lit(GAMMA), F.coalesce("l", F.lit(0)))
    own = F.when(F.col("pages") < FEW, 1.0).otherwise(content * F.col("entropy") + (1 - content) * F.coalesce("shape", F.lit(0.0)))
    return joined.select("host", "path", (own + F.col("prior")).alias("importance"), "pages")


def _text(page: list[Block], host: int, cut: dict[tuple[int, int], float]) -> str:
    named = [(b.text, cut.get((host, key(name)), KEPT), prior) for b, name, prior in _named(page)]
    kept = [text for text, importance, _ in named if importance == KEPT]
    if not kept:
        best = max((importance for _, importance, prior in named if prior >= 0), default=None)
        kept = [text for text, importance, prior in named if prior >= 0 and importance == best]
    return "\n\n".join(kept)


def _output(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    types = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "text", "n_chars"])


def _extract(cut: dict[tuple[int, int], float]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, source in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                text = _text(blocks(source)[0], key(host_of(url)), cut)
                rows.append((page_id, url, text, len(text)))
            yield _output(rows)

    return run


@tidy
def _extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, source, paths in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            host = key(host_of(url))
            text = _text(blocks(source)[0], host, {(host, p["path"]): p["importance"] for p in paths or ()})
            rows.append((page_id, url, text, len(text)))
        yield _output(rows)


@tidy
def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([key(host_of(u)) for u in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=["page_id", "url", "html", "host"])


def main_text(pages: DataFrame, least: float = LEAST, held: int = HELD, work: Workspace | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars (code points); one row per row of pages.

    Character references are decoded, white space within a block becomes one space, blocks are joined by a blank line.

    Defined cases: a null or empty html, or one without main text, has an empty text; pages with a null or bad url
    share the nameless host; a null page_id is kept as null; repeated rows are extracted each; other columns are ignored.
    """
    work = work or Workspace(pages.sparkSession, "sitetree")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    tree = work.save(style_tree(rows), "tree")
    low = tree.filter(F.col("importance") < least).select("host", "path", "importance")
    out = "page_id long, url string, text string, n_chars long"
    if low.count() <= held:
        return rows.mapInArrow(_extract({(r.host, r.path): r.importance for r in low.collect()}), out)
    # As many cut branches as a host's pages have between them; every page gets those of its host.
    per_host = low.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("paths"))
    keyed = rows.mapInArrow(_hosts, "page_id long, url string, html string, host long")
    return keyed.join(per_host, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_extract_joined, out)
