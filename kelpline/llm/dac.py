"""Directly addressable codes: token ids split into byte levels with continuation bitmaps and rank directories.

A segment file holds whole documents. Layout, all integers little-endian:

    magic b"KDAC" | u32 version | u64 documents | u64 tokens | u32 levels
    u8[documents] doc_id present | i64[documents] doc_id | u64[documents + 1] first token of each document
    per level: u64 values | u8[values] chunks | u64[ceil(values / 64)] continuation bits | u32[ceil(values / 512)] rank

Level k holds byte k of every id that has a nonzero byte at k or above (level 0: all ids). Bit i of its bitmap says
that value i goes on in level k + 1, at the place that rank(i) gives; the directory has the ones before every 512 bits.
`DacSegment.get` therefore reads one token in at most four steps, without decoding anything around it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION = b"KDAC", 1
_HEAD = struct.Struct("<4sIQQI")
_RANK = 512


def _pack_bits(flags: np.ndarray) -> np.ndarray:
    words = -(-len(flags) // 64)
    padded = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    padded[: len(packed)] = packed
    return padded.view("<u8")


def encode_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids (None allowed), tokens of each document and all ids in order -> the bytes of a segment file."""
    firsts = np.zeros(len(doc_ids) + 1, "<u8")
    np.cumsum(counts, out=firsts[1:])
    levels = []
    rest = np.asarray(ids, np.uint32)
    while len(levels) == 0 or len(rest):
        more = rest > 255
        bits = _pack_bits(more)
        blocks = np.add.reduceat(more, np.arange(0, len(more), _RANK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        rank = np.zeros(len(blocks), "<u4")
        np.cumsum(blocks[:-1], out=rank[1:])
        levels.append((struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        rest = rest[more] >> np.uint32(8)
    present = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [_HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(levels)), present.tobytes(), named.tobytes(), firsts.tobytes()]
    return b"".join(parts + [p for level in levels for p in level])


class DacSegment:
    """A view of a segment file; nothing is copied or decoded on opening."""

    def __init__(self, data: bytes):
        magic, version, docs, self.tokens, levels = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.present, self.doc_ids, self.firsts = take("u1", docs), take("<i8", docs), take("<u8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("<u8", -(-n // 64)), take("<u4", -(-n // _RANK))))

    def get(self, i: int) -> int:
        """Token i of the segment, by rank alone."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, rank in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            if not int(bits[word]) >> bit & 1:
                break
            start = i // _RANK * (_RANK // 64)
            ones = sum(int(w).bit_count() for w in bits[start:word]) + (int(bits[word]) & ((1 << bit) - 1)).bit_count()
            i, shift = int(rank[i // _RANK]) + ones, shift + 8
        return value

    def all_ids(self) -> np.ndarray:
        """Every id of the segment as uint32."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None and len(out):
                more = np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(chunks)].view(bool)
                value[more] |= out << np.uint32(8)
            out = value
        return out
