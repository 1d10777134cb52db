"""Static range asymmetric numeral systems over token ids, vectorised across lanes.

A block interleaves LANES coders: token i belongs to lane i % LANES, so one step codes LANES tokens at once. States
are 64-bit, words 32-bit (at most one word leaves a state a step). A checkpoint every CHECKPOINT steps holds the
states and the place in the words, so that parts of a block can be decoded apart.

Block layout, little endian: header (magic, tokens, first token's position within the block's shard, lanes, words,
checkpoints, crc32 of the ids, crc32 of the payload), payload = checkpoints (step u32, word u32, LANES states u64)
then words u32. The first checkpoint is step 0.
"""

from __future__ import annotations

import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np

LANES = 1024
CHECKPOINT = 128
SCALE = 20
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sIQIIIII")
MAGIC = b"rANS"


class Frequencies:
    """Counts scaled to 2**SCALE; every id that occurs keeps at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of(cls, counts: np.ndarray) -> Frequencies:
        counts = np.asarray(counts, dtype=np.int64)
        used = counts > 0
        total = 1 << SCALE
        if not used.any():
            freq = np.zeros(len(counts), np.int64)
            freq[0] = total
            return cls(freq)
        spare = total - int(used.sum())
        freq = np.where(used, 1 + np.floor(counts / counts.sum() * spare).astype(np.int64), 0)
        freq[int(counts.argmax())] += total - int(freq.sum())
        return cls(freq)


def encode(ids: np.ndarray, table: Frequencies, first: int = 0) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    marks: list[tuple[int, int, np.ndarray]] = []
    state = np.full(LANES, LOW, np.uint64)
    out: list[np.ndarray] = []
    written = 0
    shift, word = np.uint64(SCALE), np.uint64(32)
    limit = np.uint64(31 - SCALE + 32)
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES]
        f, c, x = table.freq[part], table.start[part], state[: len(part)]
        full = x >= (f << limit)
        if full.any():
            out.append(x[full].astype(np.uint32))
            written += len(out[-1])
            x = np.where(full, x >> word, x)
        state[: len(part)] = ((x // f) << shift) + x % f + c
        if step % CHECKPOINT == 0:
            marks.append((step, written, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    body = b"".join(struct.pack("<II", s, written - w) + x.tobytes() for s, w, x in marks[::-1]) + words.tobytes()
    ids_crc = zlib.crc32(ids.astype("<u4").tobytes())
    return HEADER.pack(MAGIC, n, first, LANES, len(words), len(marks), ids_crc, zlib.crc32(body)) + body


def _run(table: Frequencies, words: np.ndarray, n: int, step: int, last: int, at: int, state: np.ndarray, out: np.ndarray) -> None:
    mask, shift, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    state = state.copy()
    for k in range(step, last):
        width = min(LANES, n - k * LANES)
        x = state[:width]
        slot = x & mask
        got = table.slots[slot]
        x = table.freq[got] * (x >> shift) + slot - table.start[got]
        low = x < LOW
        if (m := int(low.sum())):
            x[low] = (x[low] << word) | words[at : at + m]
            at += m
        state[:width] = x
        out[k * LANES : k * LANES + width] = got


def decode(block: bytes, table: Frequencies, threads: int = 1) -> tuple[int, np.ndarray]:
    """First token's position and the ids of one block; each stretch between checkpoints is decoded on its own."""
    magic, n, first, lanes, n_words, n_marks, ids_crc, body_crc = HEADER.unpack_from(block)
    body = block[HEADER.size :]
    if magic != MAGIC or lanes != LANES or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    size = 8 + 8 * LANES
    words = np.frombuffer(body, "<u4", n_words, n_marks * size).astype(np.uint64)
    out = np.empty(n, np.uint32)
    steps = -(-n // LANES)
    marks = [(*struct.unpack_from("<II", body, i * size), np.frombuffer(body, "<u8", LANES, i * size + 8)) for i in range(n_marks)]
    jobs = [(table, words, n, s, marks[i + 1][0] if i + 1 < n_marks else steps, at, x.astype(np.uint64), out) for i, (s, at, x) in enumerate(marks)]
    if threads > 1:
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda j: _run(*j), jobs))
    else:
        for j in jobs:
            _run(*j)
    if zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids do not match their checksum")
    return first, out


def block_size(block: bytes, at: int) -> int:
    """Bytes of the block that begins at `at`."""
    _, n, _, lanes, n_words, n_marks, _, _ = HEADER.unpack_from(block, at)
    return HEADER.size + n_marks * (8 + 8 * lanes) + 4 * n_words
