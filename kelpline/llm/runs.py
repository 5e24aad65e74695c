"""Periodic runs of words: stretches of a text in which a phrase is said again and again.

A harmonic grid finds them. A run of period p and at least 2 p words covers two neighbouring multiples of p, so for
each p the pairs (j p, (j + 1) p) are asked how far the words agree from there on and how far they agree before: two
longest common extensions, which give the maximal stretch of that period around the pair. They are answered by the
suffix array of the words, the array of its neighbours' common prefixes and range minima over that, and by the same of
the reversed words. There are n/1 + n/2 + n/3 + ... pairs, all answered at once in numpy; most are turned away because
their two words differ.

Documents go through in blocks, with a separator of its own around each, so that one suffix array serves many short
texts and no extension leaves its document. A task needs memory for one block or one text: about 8 bytes times words
times the binary logarithm of the longest repeat, and as much for the range minima. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import tidy
from kelpline.llm.words import blocks

#: A run has LEAST words and EXPONENT periods or more. Grid pairs answered at a time.
LEAST, EXPONENT, PAIRS = 6, 4, 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


class CommonPrefixes:
    """How many symbols two suffixes of a sequence share. Symbols are small integers; the last occurs once."""

    def __init__(self, symbols: np.ndarray):
        levels = self._levels(symbols)
        n, self.rank = len(symbols), levels[-1]
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1], order[1:]
        shared = np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):  # equal ranks at level k: the next 2^k symbols are the same
            x, y = a + shared, b + shared
            shared += (levels[k][x] == levels[k][y]).astype(np.int32) << k
        del levels
        self.minima = [shared]
        while 2 << (len(self.minima) - 1) <= len(shared):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _levels(symbols: np.ndarray) -> list[np.ndarray]:
        """Ranks of all suffixes by their first 1, 2, 4, ... symbols: how many suffixes are smaller. Only ties are sorted on."""
        counts = np.bincount(symbols)
        rank = (np.cumsum(counts) - counts)[symbols].astype(np.int32)
        out, n = [rank], len(symbols)
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        step = 1
        while len(tied):
            then = rank[np.minimum(tied + step, n - 1)].astype(np.int64)  # a tied suffix goes on past its next step symbols, as the last symbol ties with none
            key = rank[tied].astype(np.int64) * n + then
            by = np.argsort(key, kind="stable")
            tied, key = tied[by], key[by]
            own = rank[tied]
            places = np.arange(len(tied))
            first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), places, 0))
            new = np.append(True, key[1:] != key[:-1])
            finer = np.maximum.accumulate(np.where(new, places, 0))
            rank = rank.copy()
            rank[tied] = own + (finer - first)
            out.append(rank)
            alone = new & np.append(new[1:], True)
            tied, step = tied[~alone], 2 * step
        return out

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols in common from places a and b on, which differ: the least common prefix between their ranks."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][lo[at]], self.minima[k][hi[at] - (1 << k)])
        return out


def grid(firsts: np.ndarray, sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places j p, periods p) of texts that begin at firsts, about PAIRS at a time; p is at most a text's words over exponent."""
    longest = sizes // exponent
    ends = np.cumsum(longest)
    total = int(ends[-1]) if len(ends) else 0
    at = 0
    while at < total:  # the (text, period) pairs at .. to
        to = min(total, at + PAIRS // 8)
        pair = np.arange(at, to)
        text = np.searchsorted(ends, pair, side="right")
        period = pair - (ends[text] - longest[text]) + 1
        steps = (sizes[text] - 1) // period
        done = np.cumsum(steps)
        cut = 0
        while cut < len(pair):
            before = int(done[cut - 1]) if cut else 0
            end = max(cut + 1, int(np.searchsorted(done, before + PAIRS, side="right")))
            n = steps[cut:end]
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(period[cut:end], n)
            yield np.repeat(firsts[text[cut:end]], n) + j * p, p
            cut = end
        at = to


def runs_of(symbols: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs, by start and period; starts are places in symbols.

    symbols: a separator, then each text followed by a separator; no two separators are alike or equal a word.
    """
    n, on, back = len(symbols), None, None
    found = [np.zeros((3, 0), np.int64)]
    for a, p in grid(firsts, sizes, exponent):
        same = symbols[a] == symbols[a + p]
        a, p = a[same], p[same]
        if len(a):
            if on is None:
                on, back = CommonPrefixes(symbols), CommonPrefixes(symbols[::-1])
            before = back.shared(n - a, n - a - p)
            start, length = a - before, p + before + on.shared(a, a + p)
            found.append(_distinct(*(x[length >= np.maximum(least, exponent * p)] for x in (start, length, p))))
    start, length, p = _distinct(*np.concatenate(found, axis=1))
    by = np.lexsort((p, start))
    return start[by], length[by], p[by]


def _distinct(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    return np.stack([start[new], length[new], period[new]])


def _find(least: int, exponent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [t.split() if t else [] for t in texts]
                sizes = np.array([len(w) for w in words], np.int64)
                firsts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
                flat = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
                symbols = len(flat.dictionary) + np.arange(int((sizes + 1).sum()) + 1)
                inside = np.arange(len(flat)) + np.repeat(np.arange(1, len(words) + 1), sizes)
                symbols[inside] = flat.indices.to_numpy(zero_copy_only=False)
                start, length, period = runs_of(symbols, firsts, sizes, least, exponent)
                cuts = np.searchsorted(start, np.append(firsts, len(symbols)))
                drop = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                drop = np.cumsum(drop) > 0
                start = start - np.repeat(firsts, np.diff(cuts))
                kept = []
                for k, own in enumerate(words):
                    if cuts[k] < cuts[k + 1]:
                        gone = drop[firsts[k] : firsts[k] + len(own)].tolist()
                        own = [w for w, g in zip(own, gone, strict=True) if not g]
                    kept.append(b" ".join(own).decode("utf-8", "replace"))
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, runs (start, length, period; by start, then period), collapsed, for every row.

    A run is a stretch of words with smallest period q, of `least` words and `exponent` (2 or more) times q at least,
    that no neighbouring word extends keeping q. `collapsed` is the text without what runs repeat: words that a run
    holds after its first q ones are left out, the rest is joined by one space.

    Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text; a null doc_id stays
    null; repeated rows are rows each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_find(least, max(2, exponent)), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_loops(text: Column, doc_id: Column) -> Column:
    """The text with its tail made periodic in one of ten documents, drawn by the checksum of the decimal id; other texts stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def looped(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, looped(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """The rows of `periodic_runs` with the longest run and digests instead of runs and texts."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
