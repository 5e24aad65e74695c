"""Token ids of whole texts, written as directly addressable segment files in doc_id order and read back."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.dac import DacSegment, encode_segment
from kelpline.llm.store import Workspace, tidy

END_ID = 2
SEGMENT_TOKENS = 1 << 20
#: Text that is tokenized at a time, and distinct words a worker remembers.
BLOCK_BYTES, KNOWN_WORDS = 3 << 20, 1 << 19

#: Words of printable ASCII and U+00C0 to U+00FF: NFC leaves them alone and lower-casing keeps their length in UTF-8.
_PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\xbf])+")

SEGMENT = "part int, seq int, start long, n_docs long, n_tokens long, data binary"


class WordTokenizer:
    """Encodes word by word, each of the first KNOWN_WORDS distinct words once.

    The vocabulary's pre-tokenizer drops white space and never crosses it, so the ids of a text are those of its
    pieces between ASCII white space, one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.byte_lengths = np.zeros(max(pieces.values()) + 1, np.int64)
        for piece, i in pieces.items():  # a character of a byte-level piece is a byte
            self.byte_lengths[i] = len(piece.removesuffix("</w>"))
        self.known = pa.array([], pa.binary())  # word i has the ids flat[firsts[i] : firsts[i + 1]]
        self.firsts, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def ids_of(self, words: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word).

        Plain words, whose bytes the normalizer keeps in number, go as one text: the byte lengths of the ids then say
        where each word ends. Any others, and all if the lengths don't add up, go one by one.
        """
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends, byte = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), np.cumsum(self.byte_lengths[ids])
            last = np.searchsorted(byte, ends)
            if len(byte) and byte[-1] == ends[-1] and (byte[last] == ends).all():
                return ids, np.diff(last + 1, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def learn(self, words: list[bytes], n: int, used: int) -> int:
        """Put the ids of words n, n + 1, ... into flat from `used` on; the end of what is used then."""
        odd = [not _PLAIN.fullmatch(w) or b"<|" in w for w in words]
        lengths, parts = np.zeros(len(words), np.int64), []
        for plain in (True, False):
            some = [i for i, o in enumerate(odd) if o is not plain]
            if some:
                ids, lengths[some] = self.ids_of([words[i] for i in some], plain)
                parts.append((some, ids))
        while n + len(words) + 1 > len(self.firsts):
            self.firsts = np.concatenate([self.firsts, np.zeros_like(self.firsts)])
        end = used + int(lengths.sum())
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        starts = used + np.cumsum(lengths) - lengths
        self.firsts[n : n + len(words)], self.firsts[n + len(words)] = starts, end
        for some, ids in parts:
            size = lengths[some]
            self.flat[np.repeat(starts[some] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return end

    def encode(self, texts: list[bytes | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text), an end id after each text if one is given."""
        pieces = [t.split() if t else [] for t in texts]
        flat = pa.array(chain.from_iterable(pieces), pa.binary()).dictionary_encode()
        place = pc.index_in(flat.dictionary, value_set=self.known)
        unknown, n = pc.is_null(place), len(self.known)
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = flat.dictionary.filter(unknown)
        if len(new):
            place[unknown.to_numpy(zero_copy_only=False)] = np.arange(n, n + len(new))
            end = self.learn(new.to_pylist(), n, self.used)
            if n + len(new) <= KNOWN_WORDS:  # else memory is full, and these words are known for this block only
                self.known, self.used = pa.concat_arrays([self.known, new]), end
        at = place[flat.indices.to_numpy(zero_copy_only=False)]
        starts, lengths = self.firsts[at], self.firsts[at + 1] - self.firsts[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.cumsum([len(p) for p in pieces])
        total = np.concatenate([[0], ends])[last]
        counts = np.diff(total, prepend=0)
        if end_id is not None:
            ids = np.insert(ids, total, end_id)
            counts = counts + 1
        return ids, counts


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which keeps its words from task to task."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def _write(path: str, end_id: int, limit: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from kelpline.llm.words import blocks

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        tokenizer = tokenizer_of(path)
        docs: list = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal seq, start, docs, counts, held, size
            data = encode_segment(docs, np.concatenate(counts), np.concatenate(held))
            row = pa.record_batch(
                [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (start, pa.int64()), (len(docs), pa.int64()), (size, pa.int64()), (data, pa.binary()))],
                names=["part", "seq", "start", "n_docs", "n_tokens", "data"],
            )
            seq, start = seq + 1, start + size
            docs, counts, held, size = [], [], [], 0
            return row

        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), BLOCK_BYTES):
                found, n = tokenizer.encode(texts, end_id)
                ends, at, done = np.cumsum(n), 0, 0
                while at < len(ids):  # whole documents until the segment is full
                    to = min(len(ids), int(np.searchsorted(ends, done + limit - size)) + 1)
                    docs += ids[at:to]
                    counts.append(n[at:to])
                    held.append(found[done : ends[to - 1]])
                    size += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if size >= limit:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, work: Workspace, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, name: str = "tokens") -> DataFrame:
    """Tokenize `docs(doc_id, text, ...)` and write segment files in ascending doc_id order; the table of segments.

    Rows are range-partitioned by doc_id, so each task writes a contiguous run of segments; `part, seq` order them
    and `start` is the segment's first token within its part. A segment is one row of a Parquet table, because
    Spark's committer makes retried tasks safe and any store that Spark can write takes it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return work.save(rows.mapInArrow(_write(tokenizer_path, end_id, segment_tokens), SEGMENT), name, compression="zstd")


def segment_starts(segments: DataFrame) -> DataFrame:
    """The segments with `start` counted from the first token of all.

    The parts' totals are broadcast: they are two numbers for each write task, whatever the data.
    """
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return segments.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


@tidy
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            segment = DacSegment(data)
            raw = memoryview(segment.all_ids().astype("<u4").tobytes())
            firsts = segment.firsts.astype(np.int64)
            cuts = (firsts * 4).tolist()
            yield pa.record_batch(
                [
                    pa.array(segment.doc_ids, mask=segment.present == 0),
                    pa.array(firsts[:-1] + base),
                    pa.array(np.diff(firsts)),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(segments: DataFrame) -> DataFrame:
    """Decode every segment file: doc_id, start, n_tokens (with the end id), ids_crc32 of each document."""
    rows = segment_starts(segments).select("start", "data")
    return rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Write the token files of docs and return, from the files alone, one row per row of docs.

    Defined cases: a null or empty text has the end id alone; a null doc_id comes before all others; rows that share
    a doc_id follow each other ordered by text; an empty table gives no files and no rows. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "tokens")
    return read_digests(write_tokens(docs, tokenizer_path, work, end_id, segment_tokens))
