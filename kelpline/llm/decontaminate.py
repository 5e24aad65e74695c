"""Benchmark decontamination: documents that hold a benchmark item up to a share of word edits.

The CGK random walk maps a word sequence to one of fixed length so that edit distance becomes Hamming distance: it
emits the word under a pointer that moves on, or stays, by a random bit of (word, step). Bit-sampling LSH over that
embedding compares item-sized windows of documents with items: in each of REPEATS rounds a few sampled steps make a
key, and windows and items with an equal key become candidates. Candidates are verified by exact edit distance
between the item and every span around the window.

Only windows that can succeed are embedded. An item of n words with at most k edits keeps one of k + 1 disjoint pieces
intact, so documents are scanned for those pieces and windows are laid where the item would start, give or take k.
This drops no true match, costs a table lookup for each word, and leaves the walks to few places.

Recall: a window at the true start with h of its n words edited agrees with the item at a sampled step with
probability of about 1 - h/n or better while the walks are in step; with s(h) the chance that a whole key agrees,
REPEATS rounds find it with 1 - (1 - s)^REPEATS. Windows at all starts within k of a piece raise that further;
tests measure the recall at the largest allowed number of edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import through, tidy
from kelpline.llm.words import HashIndex, blocks, hash_words, mix, terms_of

#: Word edits allowed, as a share of the item's words; items of fewer words than LEAST_WORDS must be there without any.
EDITS, LEAST_WORDS = 0.25, 5
#: Rounds of bit sampling, and sampled steps a round.
REPEATS, SAMPLED = 24, 2
#: Words of items that one pass over the documents holds (some 100 bytes a word). More items take more passes.
PASS_WORDS = 1 << 20

BLOCK_BYTES = 1 << 21
#: Cells of the matrices that candidates are embedded and verified in at once.
CELLS = 1 << 20

#: Han and kana characters in UTF-8: texts without blanks count each as a word.
_WIDE = re.compile(rb"(?:\xe3[\x81-\xbf]|[\xe4-\xe9][\x80-\xbf])[\x80-\xbf]")


def sought_terms(text: bytes | None) -> list[bytes]:
    """Words without case and ASCII punctuation; each character of scripts without blanks is one."""
    return terms_of(_WIDE.sub(rb" \g<0> ", text)) if text else []


FOUND = "doc_id long, item_id long, edits int, item_words int, start_word long"

_PAD = np.uint64(0xFEEDFACECAFEBEEF)


def _piece_hash(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] + np.uint64(size)
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


def cgk_keys(words: np.ndarray, sizes: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Keys (rows x rounds) of word hashes (rows x width), of which a row has sizes[row].

    sampled (rounds x k, in 0 .. 1) are places in a walk, whose steps are twice the words, as words that differ let
    it move on at every other step. A key mixes what the walk emits there; past a row's end it emits a pad.
    """
    n, rounds = len(words), len(sampled)
    row = np.repeat(np.arange(n), rounds)
    size = sizes[row]
    place = np.sort((sampled[None, :, :] * (2 * sizes[:, None, None] - 1)).astype(np.int64), axis=2).reshape(n * rounds, -1)
    places = np.ascontiguousarray(place.T)
    salt = np.tile(mix(np.arange(1, rounds + 1, dtype=np.uint64)), n)
    at, key = row * words.shape[1], salt ^ size.astype(np.uint64)
    end = at + size
    flat = np.append(words.ravel(), _PAD)
    for step in range(int(place.max()) + 1):
        here = flat[np.where(at < end, at, len(flat) - 1)]
        hit = np.flatnonzero(np.logical_or.reduce([p == step for p in places]))
        if len(hit):
            key[hit] = mix(key[hit] * np.uint64(0x9E3779B97F4A7C15) + here[hit])
        at += (((here ^ salt) * (mix(np.array([step + 1], np.uint64))[0] | np.uint64(1))) >> np.uint64(63)).astype(np.int64)
    return key.reshape(n, rounds)


def best_edits(items: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least word edits between the item and any part of the span, and that part's end."""
    rows, n, m = len(items), items.shape[1], spans.shape[1]
    end = np.arange(m + 1, dtype=np.int32)[:, None]
    before = np.zeros((m + 1, rows), np.int32)  # by end in the span; any start is free
    spans = np.ascontiguousarray(spans.T)
    for i in range(n):
        now = np.empty_like(before)
        now[0] = i + 1
        np.minimum(before[:-1] + (spans != items[:, i]), before[1:] + 1, out=now[1:])
        # A run of words of the span alone costs one each: the least of now[j'] + j - j' over j' <= j.
        before = np.minimum.accumulate(now - end, axis=0) + end
    best = before.argmin(axis=0)
    return before[best, np.arange(rows)], best


class ItemIndex:
    """A bounded set of benchmark items, ready to be sought in texts."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float = EDITS, repeats: int = REPEATS, seed: int = 0):
        by_words: dict[bytes, list[int]] = {}
        for item, text in items:
            words = sought_terms(text)
            if words:
                by_words.setdefault(b" ".join(words), []).append(item)
        self.names = [sorted(v) for v in by_words.values()]
        self.words = [hash_words(k.split(b" ")) for k in by_words]
        self.allowed = np.array([int(edits * len(w)) if len(w) >= LEAST_WORDS else 0 for w in self.words], np.int64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        rng = np.random.default_rng(seed)
        piece_keys: dict[int, list] = {}
        for i, words in enumerate(self.words):
            size = len(words) // (int(self.allowed[i]) + 1)
            for at in range(0, size * (int(self.allowed[i]) + 1), size):
                piece_keys.setdefault(size, []).append((_piece_hash(words[at : at + size], size)[0], i, at))
        self.pieces = []
        for size, rows in sorted(piece_keys.items()):
            keys = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            index = HashIndex(keys)
            firsts = np.searchsorted(keys[order], np.append(index.keys, ~np.uint64(0)))
            firsts[-1] = len(keys)
            self.pieces.append((size, index, firsts, np.array([rows[j][1] for j in order]), np.array([rows[j][2] for j in order])))
        self.sampled = rng.random((repeats, SAMPLED))
        keys = np.zeros((len(self.words), repeats), np.uint64)
        for part in self._parts(self.sizes):
            keys[part] = cgk_keys(self._items(part), self.sizes[part], self.sampled)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)

    @staticmethod
    def _parts(sizes: np.ndarray) -> Iterator[np.ndarray]:
        """The rows in runs of like size, so that a matrix of a run has about CELLS cells, or one row."""
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            end = at + max(1, CELLS // max(1, int(sizes[order[at]])))
            while end > at + 1 and (min(end, len(order)) - at) * int(sizes[order[min(end, len(order)) - 1]]) > CELLS:
                end = at + max(1, (min(end, len(order)) - at) // 2)
            yield order[at : min(end, len(order))]
            at = min(end, len(order))

    def _items(self, which: np.ndarray) -> np.ndarray:
        """The words of some items as rows, padded to the longest of them."""
        out = np.full((len(which), int(self.sizes[which].max())), _PAD)
        for row, i in enumerate(which.tolist()):
            out[row, : self.sizes[i]] = self.words[i]
        return out

    def windows(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, size) rows: places in the concatenated words of texts where an item of that size may begin."""
        found = [np.zeros((0, 2), np.int64)]
        for size, index, firsts, item, offset in self.pieces:
            at, place = index.find(_piece_hash(words, size))
            text = np.searchsorted(ends, at, side="right")
            ok = at + size <= ends[text] if len(at) else at > 0
            at, place, text = at[ok], place[ok], text[ok]
            count = firsts[place + 1] - firsts[place]
            which = np.repeat(firsts[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            text, n, k = np.repeat(text, count), self.sizes[item[which]], self.allowed[item[which]]
            rows = np.unique(np.stack([np.repeat(at, count) - offset[which], n, k, text], axis=1), axis=0)
            low = np.append(0, ends)[rows[:, 3]]
            spread = 2 * rows[:, 2] + 1
            shift = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) - np.repeat(rows[:, 2], spread)
            start = np.clip(np.repeat(rows[:, 0], spread) + shift, np.repeat(low, spread), np.repeat(ends[rows[:, 3]], spread) - 1)
            found.append(np.stack([start, np.repeat(rows[:, 1], spread)], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, start word) of every item found in a text, once each, at its best place."""
        lists = [sought_terms(t) for t in texts]
        ends = np.cumsum([len(w) for w in lists])
        words = hash_words([w for ws in lists for w in ws])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if len(words) and len(self.words):
            rows = self.windows(words, ends)
            for part in self._parts(rows[:, 1]):
                self._verify(rows[part, 0], rows[part, 1], words, ends, best)
        firsts = np.append(0, ends)
        return [(t, i, e, s - int(firsts[t])) for (t, i), (e, s) in sorted(best.items())]

    def _take(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int, low: np.ndarray) -> np.ndarray:
        at = starts[:, None] + np.arange(width)[None, :]
        inside = (at >= low[:, None]) & (at < stops[:, None])
        return np.where(inside, words[np.clip(at, 0, len(words) - 1)], _PAD)

    def _verify(self, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, ends: np.ndarray, best: dict) -> None:
        text = np.searchsorted(ends, starts, side="right")
        low, stops = np.append(0, ends)[text], ends[text]
        keys = cgk_keys(self._take(words, starts, stops, int(sizes.max()), low), sizes, self.sampled)
        pairs = []
        for r in range(keys.shape[1]):
            a = np.searchsorted(self.keys[:, r], keys[:, r], side="left")
            b = np.searchsorted(self.keys[:, r], keys[:, r], side="right")
            hit = np.flatnonzero(b > a)
            count = (b - a)[hit]
            item = self.order[np.repeat(a[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum()), r]
            pairs.append(np.repeat(hit, count) * len(self.words) + item)
        pairs = np.unique(np.concatenate(pairs))
        if not len(pairs):
            return
        window, item = pairs // len(self.words), pairs % len(self.words)
        # Neighbouring windows of a pair lie in each other's spans: verify one in every k + 1.
        k = self.allowed[item]
        _, one = np.unique(np.stack([item, text[window], starts[window] // (k + 1)], axis=1), axis=0, return_index=True)
        window, item, k = window[one], item[one], k[one]
        for n in np.unique(self.sizes[item]).tolist():
            own = np.flatnonzero(self.sizes[item] == n)
            most, step = int(k[own[0]]), max(1, CELLS // (n + 5 * int(k[own[0]]) + 1))
            for at in range(0, len(own), step):
                w, i = window[own[at : at + step]], item[own[at : at + step]]
                span = self._take(words, starts[w] - 2 * most, stops[w], n + 5 * most + 1, low[w])
                edits, end = best_edits(self._items(i), span)
                for j in np.flatnonzero(edits <= most).tolist():
                    start = max(int(low[w[j]]), int(starts[w[j]]) - 2 * most + int(end[j]) - n)
                    name = (int(text[w[j]]), int(i[j]))
                    best[name] = min(best.get(name, (n + 1, 0)), (int(edits[j]), start))


def item_passes(benchmark: DataFrame, pass_words: int = PASS_WORDS) -> Iterator[list[tuple[int, bytes]]]:
    """The items of benchmark(item_id, text), in lists that hold about pass_words words at most each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-size // (5 * pass_words))  # five characters a word at least, in any language that blanks divide
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield [(r.item_id, r.text.encode()) for r in part.orderBy("item_id", "text").collect()]


def _search(index: ItemIndex):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), BLOCK_BYTES):
                rows = [(ids[t], name, e, len(index.words[i]), s) for t, i, e, s in index.search(texts) for name in index.names[i]]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "edits", "item_words", "start_word"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, pass_words: int = PASS_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) x benchmark(item_id, text, ...) -> one row for each item found in a row of docs.

    Returns doc_id, item_id, edits (least word edits to any span), item_words, start_word (of that span). Words are
    lower-cased and freed of ASCII punctuation on both sides; each Han or kana character is a word of its own.

    Defined cases: null or empty texts and items without words find nothing; items of under LEAST_WORDS words are found word for word; items with equal words are
    all reported; a null item_id is skipped; a null doc_id is kept as null; repeated rows of docs are reported each.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = texts.mapInArrow(_search(ItemIndex([])), FOUND).limit(0)
    parts = [texts.mapInArrow(_search(ItemIndex(items, edits)), FOUND) for items in item_passes(benchmark, pass_words)]
    for k, part in enumerate(parts):
        out = part if k == 0 else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns, in one pass and without a shuffle."""
    place = docs.columns.index("text")
    for items in item_passes(benchmark, pass_words):
        index = ItemIndex(items, edits)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = batch.column(place).cast(pa.binary()).to_pylist()
                for rows, part in blocks(list(range(len(texts))), texts, BLOCK_BYTES):
                    for t, *_ in index.search(part):
                        keep[rows[t]] = False
                yield batch.filter(pa.array(keep))

        docs = through(docs, run)
    return docs
