"""Token ids of documents packed into sequences of a fixed length: first-fit decreasing in randomised groups.

A document longer than a sequence fills whole sequences of its own; what is left of it, or all of a shorter one, is an
item. Items are dealt at random into groups of bounded size, so that groups are alike and no task holds more than one.
In a group, a tournament tree over the bins' free room gives the first bin that an item fits into. Then the items of the
emptiest bins fill, cut where needed, the gaps of the others, and one last bin is parted into powers of two.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vespera.llm.common import CACHES, fresh_task, stored
from vespera.llm.token_files import SLICE_BYTES, Memory, _tokenizer
from vespera.llm.word_runs import _BLANK

LENGTH, END_ID = 2048, 1
#: Items of a group, on average; a group's ids are at most so many sequences.
GROUP = 4096
#: Gaps and pieces below so many tokens are not worth a cut.
LEAST_CUT = 8
#: Blanks that Unicode has beyond ASCII, as the tokenizer sees them; texts with them are encoded whole.
_WIDE_BLANK = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ASCII_BLANK = b" \t\n\v\f\r"
#: The alphabet of byte-level vocabularies has one letter a byte, so a token's letters are its bytes.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class ByteMemory(Memory):
    """Ids of chunks of text seen before, for byte-level files.

    Their split never joins a blank to what stands before it, so a text can be cut wherever a blank follows something
    else: chunks are a stretch of blanks and one of other characters. Other files are encoded text by text.
    """

    def __init__(self, path: str, width: str):
        import json

        self.coder, self.width = _tokenizer(path), width
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        split = x.get("pre_tokenizer") or {}
        added = x["added_tokens"]
        self.apart = x.get("normalizer") is None and all(split.get(k) == v for k, v in _BYTE_LEVEL.items()) and not any(any(map(str.isspace, t["content"])) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        vocabulary = self.coder.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        for t in added:
            self.bytes[t["id"]] = len(t["content"].encode())
        self.clear()

    def learn(self, new: list[str]) -> None:
        """Chunks that begin with a blank and end otherwise are encoded in blocks, as one text, and told apart by the bytes of their ids."""
        apart = lambda c: c[0] in _ASCII_BLANK and c[-1] not in _ASCII_BLANK
        inner = [c for c in new if apart(c)]
        for lo in range(0, len(inner), 512):
            block = inner[lo : lo + 512]
            ids = np.array(self.coder.encode(b"".join(block).decode(), add_special_tokens=False).ids, self.width)
            ends = np.cumsum(self.bytes[ids])
            stop = np.searchsorted(ends, np.cumsum([len(c) for c in block])) + 1
            if len(ids) != stop[-1] or ends[-1] != sum(map(len, block)):
                raise ValueError("the tokenizer's ids do not spell the text")
            self._add(block, ids, stop)
        if len(inner) < len(new):
            edges = [c for c in new if not apart(c)]
            self._add(edges, *self._coded([c.decode() for c in edges]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of each text's, exactly as the library gives them for whole texts."""
        whole = pc.match_substring_regex(texts, pattern=_WIDE_BLANK).to_numpy(zero_copy_only=False).astype(bool) if self.apart else np.ones(len(texts), bool)
        if whole.all():
            return self._each(texts)
        if whole.any():
            ids, n = self._chunked(texts.filter(pa.array(~whole)))
            others, m = self._each(texts.filter(pa.array(whole)))
            return _interleaved(whole, ids, n, others, m)
        return self._chunked(texts)

    def _each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(self.coder.encode(t, add_special_tokens=False).ids, self.width) for t in texts.to_pylist()]
        return np.concatenate([*coded, np.zeros(0, self.width)]), np.array([len(x) for x in coded], np.int64)

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > 600_000:
            self.clear()
        offsets, data = texts.buffers()[1:3]
        edge = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if edge[-1] > edge[0] else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        blank = _BLANK[body]
        cut = np.zeros(len(body) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[edge] = True
        at = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = list(map(self.chunks.get, distinct))
        if None in number:
            self.learn([w for w, k in zip(distinct, number) if k is None])
            number = list(map(self.chunks.get, distinct))
        number = np.array(number, np.int64)
        first, length = self.start[number], self.start[number + 1] - self.start[number]
        which = coded.indices.to_numpy(zero_copy_only=False)
        size = length[which]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(first[which] - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(at, edge)])


def _interleaved(second: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a (of n ids each) and of b (m), in the order that second (which rows are b's) tells."""
    size = np.zeros(len(second), np.int64)
    size[~second], size[second] = n, m
    of_b = np.repeat(second, size)
    out = np.empty(len(of_b), a.dtype)
    out[~of_b], out[of_b] = a, b
    return out, size


def items(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces before packing: doc_id, start, length, doc_tokens, ids (binary, little-endian), sequence, place.

    A piece of a whole sequence has its sequence's number; what is left over has null and a random place in 0..1.
    """
    got = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    names = [("doc_id", got.schema[0].dataType), ("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType()), ("sequence", T.LongType()), ("place", T.DoubleType())]
    schema = T.StructType([T.StructField(*x) for x in names])
    arrow = to_arrow_schema(schema)
    width = id_width(tokenizer, end_id)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kind = f"bytes {tokenizer}"
        fresh_task(kind)
        memory = CACHES[kind] = CACHES.get(kind) or ByteMemory(tokenizer, width)
        task = TaskContext.get().partitionId()
        rng, filled = np.random.default_rng((seed, task)), task << 32
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES)))
                ids, n = memory.encode(batch.column(1).slice(lo, hi - lo))
                total = n + 1
                last = np.cumsum(total)
                out = np.empty(len(ids) + len(n), width)
                body = np.ones(len(out), bool)
                body[last - 1] = False
                out[body], out[last - 1] = ids, end_id
                pieces = -(-total // length)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                long = np.minimum(length, total[row] - start)
                full = long == length
                edges = np.concatenate(([0], np.cumsum(long * out.itemsize))).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(out)])
                number = filled + np.cumsum(full) - 1
                filled += int(full.sum())
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(long), pa.array(total[row]), binary, pa.array(number, mask=~full), pa.array(rng.random(len(row)))], schema=arrow)
                lo = hi

    return got.mapInArrow(run, schema)


def id_width(tokenizer: str, end_id: int = END_ID) -> str:
    return "<u2" if max(end_id + 1, _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True)) <= 1 << 16 else "<u4"


class Bins:
    """Free room of bins in a tournament tree: the first bin with enough room is found, and updated, in log steps."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.best = [room] * (2 * self.leaves)
        self.used = 0

    def put(self, size: int) -> int:
        """The first bin that size fits into, after it was put there."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        bin_ = k - self.leaves
        best[k] -= size
        self.used = max(self.used, bin_ + 1)
        while k > 1:
            k >>= 1
            winner = max(best[2 * k], best[2 * k + 1])
            if best[k] == winner:
                break
            best[k] = winner
        return bin_


def fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """First-fit decreasing: bins of items (their places in sizes, largest first), none of more than length in all."""
    bins = Bins(max(1, len(sizes)), length)
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = bins.put(sizes[i])
        if b == len(out):
            out.append([])
        out[b].append(i)
    return out


def fill(sizes: list[int], bins: list[list[int]], length: int = LENGTH, least: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, size): pieces of the emptiest bins fill the gaps of the others; the last one is parted into powers of two.

    Gaps below `least` stay, and a cut leaves no piece below it where that can be helped.
    """
    out = [[(i, 0, sizes[i]) for i in b] for b in bins]
    room = [length - sum(sizes[i] for i in b) for b in bins]
    done = [k for k, r in enumerate(room) if r < least]
    open_ = sorted((k for k, r in enumerate(room) if r >= least), key=lambda k: (room[k], k))
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        to, source = open_[lo], out[open_[hi]]
        if room[to] < least:
            done.append(to)
            lo += 1
        elif not source:
            hi -= 1
        else:
            i, at, size = source.pop()
            take = size if size <= room[to] else room[to] if size - room[to] >= least else size - least
            out[to].append((i, at, take))
            room[to] -= take
            if take < size:
                source.append((i, at + take, size - take))
    return [out[k] for k in done] + [part for k in open_[lo : hi + 1] for part in parted(out[k], length)]


def parted(pieces: list[tuple[int, int, int]], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """The pieces in parts that hold a power of two each, the largest first; as they are if they fill a sequence."""
    out, left, queue = [], sum(p[2] for p in pieces), list(reversed(pieces))
    while left:
        want = left if left == length else 1 << (left.bit_length() - 1)
        part, left = [], left - want
        while want:
            i, at, size = queue.pop()
            take = min(size, want)
            part.append((i, at, take))
            want -= take
            if take < size:
                queue.append((i, at + take, size - take))
        out.append(part)
    return out


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, least: int = LEAST_CUT, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary), ids_crc32.

    A document's ids are the tokenizer's (without special ones) and end_id; each of them lies in exactly one piece. A
    sequence holds at most `length` ids, offsets in it are gapless from 0; sequences() puts the pieces together. Items
    are dealt into groups by random numbers that are stored with them, so a repeated task deals alike, and repeated rows
    or texts meet in no group. Items are at most `length` ids, so a group is bounded whatever the texts are. Null and
    empty texts are their end id alone; null and repeated ids are kept, a row's pieces have its id. An empty table gives
    an empty one.
    """
    cut = stored(items(docs, tokenizer, length, end_id, seed, id_col, text_col), "items", compression="zstd")
    short = cut.where(F.col("sequence").isNull())
    n = short.count()
    groups = max(1, -(-n // group))
    width = np.dtype(id_width(tokenizer, end_id))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "ids_crc32"]
    kind = cut.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(x, kind if x == "doc_id" else T.BinaryType() if x == "ids" else T.LongType()) for x in names])
    arrow = to_arrow_schema(schema)

    def crc(ids: bytes) -> int:
        return zlib.crc32(np.frombuffer(ids, width).astype("<u4"))

    def whole(batches):
        fresh_task()
        for batch in batches:
            sums = pa.array([crc(x) for x in batch.column(5).to_pylist()], pa.int64())
            zero = pa.array(np.zeros(batch.num_rows, np.int64))
            number = pc.multiply(batch.column(4), 2)  # even; those of groups are odd
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], number, zero, batch.column(5), sums], schema=arrow)

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("place", "ascending")])
        sizes, ids = table["length"].to_pylist(), table["ids"].to_pylist()
        first = table["group"][0].as_py() << 32
        of, start, size, number, offset, parts = [], [], [], [], [], []
        for k, b in enumerate(fill(sizes, fit(sizes, length), length, least)):
            at = 0
            for i, lo, take in b:
                of.append(i)
                start.append(lo)
                size.append(take)
                number.append(2 * (first + k) + 1)
                offset.append(at)
                parts.append(ids[i][lo * width.itemsize : (lo + take) * width.itemsize])
                at += take
        rows = table.take(pa.array(of, pa.int64()))
        cols = [rows["doc_id"], pc.add(rows["start"], pa.array(start, pa.int64())), pa.array(size, pa.int64()), rows["doc_tokens"], pa.array(number, pa.int64()), pa.array(offset, pa.int64()), pa.array(parts, pa.binary()), pa.array(map(crc, parts), pa.int64())]
        return pa.Table.from_arrays(cols, schema=arrow)

    full = cut.where(F.col("sequence").isNotNull()).select("doc_id", "start", "length", "doc_tokens", "sequence", "ids").mapInArrow(whole, schema)
    dealt = short.select("doc_id", "start", "length", "doc_tokens", "ids", "place", F.floor(F.col("place") * groups).cast("long").alias("group"))
    return full.unionByName(dealt.groupBy("group").applyInArrow(each, schema))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary): the pieces of each sequence put together in the order of their offsets."""
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
