"""Packing of documents into sequences: a configuration linear program over the histogram of lengths.

Texts become pieces of at most `capacity` tokens, and only the histogram of their lengths (a number for each length)
reaches the driver. A configuration is a multiset of lengths that fits in a sequence; the linear program asks how often
to use each, so that every length is covered and the fewest sequences are used. Multiplicative weights solve it: a
length's price falls exponentially with the share of it that is covered, and a knapsack program over all capacities
prices configurations, over a few hundred lengths at a time; one pass of it gives the best configuration around each of
them. Configurations of nearly the best price are used as often as the lengths in them last, in phases that cover all
lengths evenly. Multiplicities are rounded down to whole numbers as they are chosen, and best fit, longest first, packs
what that leaves over, again by length and count. The plan's size follows `capacity`, not the data.

Pieces of a length are alike: each gets its place among them (slices of the hot lengths are counted, then numbered
within), and the plan says which sequence and offset that place has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace, tidy
from kelpline.llm.tokens import BLOCK_BYTES, tokenizer_of
from kelpline.llm.words import blocks

CAPACITY, END_ID = 4096, 1
#: Phases of the weights, pricings in each at most, lengths priced together, the exponent's rate, and how far below the best price a configuration may be.
PHASES, PRICINGS, PART, RATE, SLACK = 2, 8, 384, 0.003, 0.0001
#: Pieces of a length that are numbered together, and slices of a length at most.
SLICE, SLICES = 512, 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Knapsack:
    """The best multisets of lengths for all capacities at once, no length more often than there are pieces of it."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int):
        self.best = np.zeros(capacity + 1)
        self.steps: list[tuple[int, int, np.ndarray]] = []
        for k in range(len(lengths) - 1, -1, -1):
            left, times = min(int(counts[k]), capacity // int(lengths[k])), 1
            while left > 0:  # 1, 2, 4, ... of a length together give every number of it
                take = min(times, left)
                size = take * int(lengths[k])
                tried = self.best[:-size] + take * prices[k]
                better = tried > self.best[size:] + 1e-12
                np.copyto(self.best[size:], tried, where=better)
                self.steps.append((k, take, better))
                left, times = left - take, 2 * times

    def sets(self, rooms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rooms' places, lengths' places, times) of the best sets for each room, by room."""
        left, rows, cols, times = rooms.copy(), [], [], []
        for k, take, better in reversed(self.steps):
            size = take * int(lengths[k])
            at = np.flatnonzero(left >= size)
            at = at[better[left[at] - size]]
            left[at] -= size
            rows.append(at)
            cols.append(np.full(len(at), k))
            times.append(np.full(len(at), take))
        row, col, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, times))
        by = np.argsort(row, kind="stable")
        return row[by], col[by], n[by]


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """([(times by place in lengths, sequences)], pieces left of each length) by multiplicative weights."""
    left, out, rng = counts.copy(), [], np.random.default_rng(0)
    total = int((counts * lengths).sum())
    for phase in range(1, PHASES + 1):
        goal = (counts * (PHASES - phase)) // PHASES  # pieces to be left after this phase; the next one's may be begun
        floor = (counts * max(0, PHASES - phase - 1)) // PHASES
        for _ in range(PRICINGS):
            open_ = np.flatnonzero(left > 0)
            if not (left > goal).any():
                break
            prices = lengths * np.exp(RATE * (left / counts - (left * lengths).sum() / total))
            parts = [np.sort(x) for x in np.array_split(rng.permutation(open_), -(-len(open_) // PART))]
            sacks = [Knapsack(lengths[x], left[x], prices[x], capacity) for x in parts]
            most = max(x.best[capacity] for x in sacks)
            for part, sack in zip(parts, sacks, strict=True):
                first = part[left[part] > goal[part]][::-1]
                rooms = capacity - lengths[first]
                good = prices[first] + sack.best[rooms] >= (1 - SLACK) * most
                first, rooms = first[good], rooms[good]
                row, col, n = sack.sets(rooms, lengths[part])
                cuts = np.searchsorted(row, np.arange(len(first) + 1))
                for j, f in enumerate(first.tolist()):
                    need = int(left[f] - goal[f])
                    if need <= 0:
                        continue
                    config = {f: 1}
                    for c, t in zip(part[col[cuts[j] : cuts[j + 1]]].tolist(), n[cuts[j] : cuts[j + 1]].tolist(), strict=True):
                        config[c] = config.get(c, 0) + t
                    often = min(-(-need // config[f]), *(int(left[c] - floor[c]) // t for c, t in config.items()))
                    if often > 0:
                        for c, t in config.items():
                            left[c] -= often * t
                        out.append((config, often))
    return out, left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """What the program leaves, longest first, each into the fullest sequence that still takes it; equal ones in one go."""
    import bisect

    rooms: list[int] = []  # ascending, of the sequences that are begun
    begun: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, config: dict[int, int], n: int) -> None:
        if room not in begun:
            bisect.insort(rooms, room)
            begun[room] = []
        begun[room].append((config, n))

    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        while n > 0:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, {k: each}, n // each)
                    n %= each
                if n:
                    put(capacity - n * size, {k: n}, 1)
                    n = 0
                continue
            room = rooms[at]
            config, have = begun[room].pop()
            if not begun[room]:
                del begun[room], rooms[at]
            each = min(room // size, n)
            take = min(have, n // each)
            if have > take:
                put(room, config, have - take)
            put(room - each * size, config | {k: config.get(k, 0) + each}, take)
            n -= each * take
    return [x for group in begun.values() for x in group]


class Plan:
    """Where the i-th piece of each length goes. Each run is a configuration's share of a length's pieces."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        lengths = np.array(sorted(histogram), np.int64)
        counts = np.array([histogram[int(x)] for x in lengths], np.int64)
        chosen, left = configurations(lengths, counts, capacity)
        chosen += best_fit(lengths, left, capacity)
        used, runs, self.sequences = np.zeros(len(lengths), np.int64), [], 0
        for config, often in chosen:
            offset = 0
            for k, times in sorted(config.items(), reverse=True):
                runs.append((int(lengths[k]), int(used[k]), self.sequences, times, offset))
                used[k] += often * times
                offset += times * int(lengths[k])
            self.sequences += often
        assert (used == counts).all(), "every piece has its place"
        runs.sort()
        self.length, self.first, self.sequence, self.times, self.offset = (np.array([r[c] for r in runs], np.int64) for c in range(5))

    def place(self, length: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequences, offsets) of the i-th pieces (from 0) of these lengths."""
        size = int(self.first.max(initial=0)) + 1
        run = np.searchsorted(self.length * size + self.first, length * size + np.minimum(i, size - 1), side="right") - 1
        nth = i - self.first[run]
        return self.sequence[run] + nth // self.times[run], self.offset[run] + nth % self.times[run] * length


def _cut(path: str, end_id: int, capacity: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            for docs, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), BLOCK_BYTES):
                ids, n = tokenizer.encode(texts, end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(docs)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = (np.cumsum(n) - n)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32: each text's ids and end id, cut at every `capacity`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECES)


def _place(plan: Plan):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, i = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "place"))
            sequence, offset = plan.place(length, i)
            kept = batch.drop_columns(["place"])
            yield pa.record_batch([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, work: Workspace | None = None) -> DataFrame:
    """pieces (doc_id, piece, length 1 .. capacity, ...), a table that reads alike each time -> the same with sequence_id, offset.

    A length's pieces are numbered in slices by a hash of (doc_id, piece), so that one common length is many tasks.
    """
    spark = pieces.sparkSession
    work = work or Workspace(spark, "packing")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not histogram:
        return pieces.selectExpr("*", "0L AS sequence_id", "0L AS offset")
    plan = Plan(histogram, capacity)
    cuts = spark.createDataFrame([(k, min(SLICES, -(-n // SLICE))) for k, n in histogram.items()], "length long, cuts int")
    sliced = pieces.join(F.broadcast(cuts), "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.col("cuts")).cast("int")).drop("cuts")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", *[c for c in pieces.columns if c not in ("length", "doc_id", "piece")])
    placed = sliced.withColumn("place", F.row_number().over(nth) - 1).join(base, ["length", "slice"])
    placed = placed.select(*pieces.columns, (F.col("place") + F.col("base")).alias("place"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return placed.mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are documents each;
    an empty table gives no rows; other columns are ignored. Only texts of more than `capacity` ids are cut.
    """
    work = Workspace(docs.sparkSession, "packing")
    return pack(work.save(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, work)
