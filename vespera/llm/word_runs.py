"""Periodic runs of words: stretches that repeat with a period, found in whole texts and folded to their first period.

A run's period is the length of a Lyndon word: the longest Lyndon factor at one of its places, under one of two orders
that are each other's reverse. Factors come from a stack that is scanned from right to left. Places are compared, and runs
are extended, by the length of what they have in common: a binary search over rolling hashes, whose answer is then held
against the words themselves.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vespera.llm.common import fresh_task, slices

MIN_WORDS, MIN_EXPONENT = 24, 3
#: Texts that a task holds as arrays at once: rows, and bytes; a longer text makes a slice of its own.
ROWS, BYTES = 2048, 1 << 22
#: Base of the rolling hash (odd, so that it has an inverse modulo 2^64) and the mask of its numbers.
BASE, MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
#: Words that are compared one by one before hashes are.
NEAR = 8

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (strings without null) one after another, and how many each text has."""
    offsets, data = texts.buffers()[1:3]
    edge = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if edge[-1] > edge[0] else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    blank, starts, no = _BLANK[body], np.zeros(len(body) + 1, bool), np.zeros(min(1, len(body)), bool)
    starts[edge] = True
    begin = np.flatnonzero(~blank & (starts[:-1] | np.concatenate((no, blank[:-1]))))
    end = np.flatnonzero(~blank & (starts[1:] | np.concatenate((blank[1:], no)))) + 1
    at = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(body[~blank])])
    return words, np.diff(np.searchsorted(begin, edge))


def mixed(x: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each number."""
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, n of them; short ones are kept."""
    bits = max(10, (n - 1).bit_length())
    return (_powers if bits <= 20 else _powers.__wrapped__)(bits, base)[:n]


def sums(codes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(codes) * powers(len(codes), BASE), dtype=np.uint64)))


def suspects(codes: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """The texts that hold one window of so many words twice (or seem to, by its hash); only those can hold a run."""
    n = len(codes) - window + 1
    if n < 2:
        return np.zeros(0, np.int64)
    s = sums(codes)
    inverse = pow(BASE, -1, 1 << 64)
    key = mixed((s[window:] - s[:-window]) * powers(n, inverse) + mixed(text[:n]))
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    order = inside[np.argsort(key[inside])]
    return np.unique(text[order[1:][key[order[1:]] == key[order[:-1]]]])


class Extensions:
    """How far two places of a sequence of codes go on alike, forwards and backwards."""

    def __init__(self, codes: np.ndarray):
        self.n, self.w = len(codes), codes.tolist()
        self.sums, self.powers = memoryview(sums(codes)), memoryview(powers(len(codes), BASE))
        #: By distance: the place and length of one stretch that was verified to equal the one so far behind it.
        self.known: dict[int, tuple[int, int]] = {}

    def _most(self, i: int, j: int, low: int, high: int, step: int) -> int:
        """The largest length in low..high whose hashes agree, of the words from i and j on (step 1) or before them (-1)."""
        s, factor = self.sums, self.powers[j - i]
        while low < high:
            k = (low + high + 1) // 2
            a, b = (i, j) if step > 0 else (i - k, j - k)
            if ((s[a + k] - s[a]) * factor - s[b + k] + s[b]) & MASK:
                high = k - 1
            else:
                low = k
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j); exact."""
        w, d, room = self.w, j - i, self.n - j
        at, known = self.known.get(d, (-1, 0))
        if at <= i < at + known:
            return at + known - i
        k, near = 0, min(room, NEAR)
        while k < near and w[i + k] == w[j + k]:
            k += 1
        if k < NEAR or k == room:
            return k
        if i < at <= i + k:
            k = at - i + known
        else:
            guess = self._most(i, j, k, room, 1)
            meets = i < at <= i + guess  # the rest has been verified
            size = at - i if meets else guess
            if w[i : i + size] == w[j : j + size] and (meets or j + size == self.n or w[i + size] != w[j + size]):
                k = size + known if meets else size
            else:  # hashes collided: by the words alone
                while k < room and w[i + k] == w[j + k]:
                    k += 1
        self.known[d] = (i, k)
        return k

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j); exact."""
        w, k = self.w, 0
        while k < min(i, NEAR) and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < NEAR or k == i:
            return k
        size = self._most(i, j, k, i, -1)
        if w[i - size : i] == w[j - size : j] and (size == i or w[i - size - 1] != w[j - size - 1]):
            return size
        while k < i and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        return k

    def factors(self, order: list[int]) -> np.ndarray:
        """Where the longest Lyndon word that begins at each place ends; order: the codes, or their mirror image."""
        n, ahead = self.n, self.ahead
        ends = [n] * (n + 1)  # the stack: ends[i], ends[ends[i]], ... are the places it holds
        for i in range(n - 1, -1, -1):
            a, j = order[i], i + 1
            while j < n:
                b = order[j]
                if a == b:
                    k = ahead(i, j)
                    if j + k == n or order[i + k] > order[j + k]:
                        break
                elif a > b:
                    break
                j = ends[j]
            ends[i] = j
        return np.array(ends[:n], np.int64)


def runs_of(codes: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least min_words words and min_exponent (2 or more) periods."""
    if len(codes) < max(2, min_words):
        return []
    text, found = Extensions(codes), set()
    top = max(text.w)
    for order in (text.w, [top - x for x in text.w]):
        ends = text.factors(order)
        places = np.flatnonzero(ends < len(codes))
        if min_exponent >= 3:  # such a run has two whole roots side by side
            root = ends[places]
            places = places[(ends[root] - root == root - places) & (codes[places] == codes[root])]
        done: dict[int, int] = {}  # by period: up to where places belong to the last run
        for i, j in zip(places.tolist(), ends[places].tolist()):
            p = j - i
            if i < done.get(p, 0):
                continue
            b, f = text.behind(i, j), text.ahead(i, j)
            done[p] = i + f
            if b + f + p >= max(min_words, min_exponent * p):
                found.add((i - b, b + f + p, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start, then period), collapsed (text).

    collapsed has the words of the text, joined by one space, without those that a run holds after its first period.
    Words are parted by ASCII blanks. Whole texts are read in one pass without a shuffle, so repeated rows, ids or
    texts meet in no task. A text without two equal windows of min_words * (1 - 1 / min_exponent) words has no run and
    is not scanned further. Null and empty texts have no words, no runs and an empty collapsed text; ids may be null
    or repeated, each row gives a row; other columns are not looked at. An empty table gives an empty one.
    """
    if min_exponent < 2 or min_words < 2:
        raise ValueError("a run has two periods and two words at least")
    got = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", got.schema[0].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)
    window = -(-min_words * (min_exponent - 1) // min_exponent)

    def each(batches):
        fresh_task()
        for batch in batches:
            for part in slices(batch, ROWS, BYTES):
                words, n = words_of(part.column(1))
                first = np.concatenate(([0], np.cumsum(n)))
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                found: list[list[dict]] = [[]] * len(n)
                fold = np.zeros(len(codes) + 1, np.int64)
                for d in suspects(codes, np.repeat(np.arange(len(n)), n), window).tolist():
                    at = int(first[d])
                    runs = runs_of(codes[at : first[d + 1]], min_words, min_exponent)
                    found[d] = [{"start": s, "length": size, "period": p} for s, size, p in runs]
                    for s, size, p in runs:
                        fold[at + s + p] += 1
                        fold[at + s + size] -= 1
                keep = np.cumsum(fold[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(keep)))[first].astype(np.int32)
                kept = words if keep.all() else words.filter(pa.array(keep))
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), kept), b" ").cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(found, arrow.field("runs").type), collapsed], schema=arrow)

    return got.mapInArrow(each, schema)
