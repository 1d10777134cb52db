"""Token ids of documents in binary shard files, coded with a static rANS and one shared frequency table.

A data set is a folder: `frequencies` (Parquet: id, freq) and `shards` (one binary file a range of doc_id, in
ascending order). A shard is a sequence of frames, each ended by one line feed byte that belongs to the frame:
index frames list documents (ids, token counts, crc32s), block frames hold rANS blocks. Spark's own file writer
commits the shards, so a lost executor leaves no half file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vespera.llm import rans
from vespera.llm.common import CACHES, checked, drop_stored, fresh_task, scratch, stored

BLOCK = 1 << 19
END_ID = 2
#: Tokens a shard aims at.
SHARD_TOKENS = 16_000_000
#: Distinct blank-separated chunks whose ids a Python worker remembers at most; then it starts anew.
REMEMBERED = 600_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 23
FRAME = struct.Struct("<cQ")
#: Fixed value: the split of the tokenizer files that lets no white space through.
CHUNKED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Latin text without controls and combining marks, on which normalising is lower-casing alone.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")
#: CHUNKED for such text, in the terms of re.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
_MARKS = r"([^\s\pL\pN']+)"
_NOT_SIMPLE = r"[^\t-\r\x20-\x7e\xa1-\xac\xae-\x{12f}\x{131}-\x{24f}]|<\||[^\s\pL\pN']'|'[^\s\pL\pN']|''"


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_chunks(path: str) -> bool:
    """Whether ASCII blanks always part this file's words, so that chunks between blanks can be encoded apart.

    Holds where white space is first made one space and every piece that the split lets through is free of it.
    """
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    norm = (x.get("normalizer") or {}).get("normalizers", [])
    split = ((x.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    whole = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in x["added_tokens"])
    return whole and any(n.get("type") == "Replace" and n["pattern"] == {"Regex": "\\s+"} for n in norm) and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and split["pattern"] == {"Regex": CHUNKED}


class Memory:
    """A tokenizer and the ids of chunks seen before, one after another in a pool."""

    def __init__(self, path: str, width: str):
        self.coder, self.width = _tokenizer(path), width
        self.apart = by_chunks(path)
        vocabulary = self.coder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 20, self.width)
        self.start = np.zeros(1 << 18, np.int64)  # chunk k has pool[start[k] : start[k + 1]]

    def _coded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks and where each chunk's end."""
        each = [np.array(e.ids, self.width) for e in self.coder.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.concatenate([*each, np.zeros(0, self.width)]), np.cumsum([len(x) for x in each], dtype=np.int64)

    def _pieces(self, words: list[str], parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of one piece and chunks of several; pieces parted by a space are encoded as one text and told apart by the ids that end a piece."""
        flat = [*words, *chain.from_iterable(parts)]
        blocks = [flat[i : i + 256] for i in range(0, len(flat), 256)]
        each = [np.array(e.ids, self.width) for e in self.coder.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)]
        if any(int(self.ends[x].sum()) != len(b) for b, x in zip(blocks, each)):
            return self._coded([*words, *map("".join, parts)])
        ids = np.concatenate([*each, np.zeros(0, self.width)])
        stop = np.flatnonzero(self.ends[ids]) + 1
        return ids, np.concatenate([stop[: len(words)], stop[len(words) + np.cumsum([len(p) for p in parts], dtype=np.int64) - 1]])

    def learn(self, new: list[str]) -> None:
        words = [w for w in new if w.isalpha() and _PLAIN.fullmatch(w)]
        plain = [w for w in new if not w.isalpha() and _PLAIN.fullmatch(w) and "<|" not in w]
        self._add(words + plain, *self._pieces(list(map(str.lower, words)), [_PIECE.findall(w.lower()) for w in plain]))
        if len(words) + len(plain) < len(new):
            other = list(set(new).difference(words, plain))
            self._add(other, *self._coded(other))

    def _add(self, chunks: list[str], ids: np.ndarray, stop: np.ndarray) -> None:
        n = len(self.chunks)
        end = int(self.start[n])
        while end + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(chunks) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.pool[end : end + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(chunks)] = end + stop
        self.chunks.update(zip(chunks, range(n, n + len(chunks))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of each text's, exactly as encode_batch gives them for whole texts."""
        if not self.apart:
            coded = [np.array(e.ids, self.width) for e in self.coder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(coded), np.array([len(x) for x in coded], np.int64)
        if len(self.chunks) > REMEMBERED:
            self.clear()
        # Latin texts: lower case, and marks parted from words. Where an apostrophe meets another mark they stay as they are.
        simple = pc.invert(pc.match_substring_regex(texts, pattern=_NOT_SIMPLE))
        texts = pc.if_else(simple, pc.replace_substring_regex(pc.utf8_lower(texts), pattern=_MARKS, replacement=r" \1 "), texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.chunks.get, distinct))
        if None in number:
            self.learn([w for w, k in zip(distinct, number) if k is None])
            number = list(map(self.chunks.get, distinct))
        number = np.array(number, np.int64)
        first, length = self.start[number], self.start[number + 1] - self.start[number]
        which = coded.indices.to_numpy(zero_copy_only=False) if len(number) else np.zeros(0, np.int32)
        size = length[which]
        before = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(first[which] - before[:-1], size)
        at += np.arange(before[-1])
        ids = self.pool[at]
        return ids, np.diff(before[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))))])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian u2, or u4 for vocabularies beyond 65,536); null texts count as empty."""
    got = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    struct_ = T.StructType([T.StructField("doc_id", got.schema[0].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    width = "<u2" if _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kind = f"tokens {tokenizer}"
        fresh_task(kind)
        memory = CACHES[kind] = CACHES.get(kind) or Memory(tokenizer, width)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES)))
                ids, n = memory.encode(batch.column(1).slice(lo, hi - lo))
                last = np.cumsum(n + 1)
                out = np.empty(len(ids) + len(n), width)
                body = np.ones(len(out), bool)
                body[last - 1] = False
                out[body], out[last - 1] = ids, end_id
                edges = np.concatenate(([0], last * out.itemsize)).astype("<i4")
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n + 1, pa.int64()), binary], names=["doc_id", "n_tokens", "ids"])
                lo = hi

    return got.mapInArrow(run, struct_)


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, over all documents; at most `vocabulary` sums reach the driver."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        fresh_task()
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                joined = b"".join(batch.column(0).slice(lo, 512).to_pylist())
                total += np.bincount(np.frombuffer(joined, width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def _frame(kind: bytes, body: bytes) -> bytes:
    return FRAME.pack(kind, len(body)) + body


def _frames(data: bytes):
    at = 0
    while at < len(data):
        kind, size = FRAME.unpack_from(data, at)
        yield kind, data[at + FRAME.size : at + FRAME.size + size]
        if data[at + FRAME.size + size : at + FRAME.size + size + 1] != b"\n":
            raise ValueError("a frame has no end mark")
        at += FRAME.size + size + 1


def write_tokens(tokens: DataFrame, path: str, vocabulary: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write tokenize()'s rows, which must be stored (they are read several times), as a data set below path."""
    spark = tokens.sparkSession
    table = rans.Frequencies.of(count_ids(tokens, vocabulary))
    spark.createDataFrame(pa.table({"id": np.arange(vocabulary, dtype=np.int32), "freq": table.freq.astype(np.int64)}).to_pandas()).coalesce(1).write.parquet(f"{path}/frequencies")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_tokens), min(spark.sparkContext.defaultParallelism, total // 200_000))
    shared = spark.sparkContext.broadcast(table.freq)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        fresh_task()
        coder = rans.Frequencies(shared.value)
        docs: list[tuple[int | None, int, int]] = []
        held: list[np.ndarray] = []
        n = place = 0

        def flush():
            ids = np.concatenate(held)
            known = np.array([d is not None for d, _, _ in docs], np.uint8)
            index = struct.pack("<I", len(docs)) + known.tobytes() + np.array([d or 0 for d, _, _ in docs], "<i8").tobytes() + np.array([k for _, k, _ in docs], "<u8").tobytes() + np.array([c for _, _, c in docs], "<u4").tobytes()
            yield _frame(b"D", struct.pack("<I", zlib.crc32(index)) + index)
            for lo in range(0, len(ids), BLOCK):
                yield _frame(b"B", rans.encode(ids[lo : lo + BLOCK], coder, place + lo))

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(x, width)
                held.append(ids)
                docs.append((d, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                n += len(ids)
                if n >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([*flush()], pa.binary())], names=["frame"])
                    place += n
                    docs, held, n = [], [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([*flush()], pa.binary())], names=["frame"])

    ordered = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    frames = ordered.select("doc_id", "ids").mapInArrow(run, "frame binary")
    # The text writer puts the bytes of a string out as they are, each followed by the line feed.
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, threads: int = 1) -> DataFrame:
    """One row per document of the data set, decoded and verified: doc_id, start, n_tokens, ids_crc32 (and ids).

    Shards are read in parallel; within a block, threads stretches between checkpoints are decoded at once.
    """
    freq = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()["freq"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(freq)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content")
    fields = "shard long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        fresh_task()
        coder = rans.Frequencies(shared.value)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, docs, parts = 0, None, []

                def done():
                    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                    out, at = [], 0
                    for d, k, crc in docs:
                        own = ids[at : at + k].astype("<u4").tobytes()
                        if zlib.crc32(own) != crc:
                            raise ValueError(f"a document of shard {name} does not match its checksum")
                        out.append((d, place + at, k, zlib.crc32(own), own))
                        at += k
                    if at != len(ids):
                        raise ValueError(f"shard {name} holds {len(ids)} ids where its index lists {at}")
                    cols = [pa.array([name] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([o[4] for o in out], pa.binary()))
                    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in fields.split(", ")]), place + at

                for kind, body in _frames(data):
                    if kind == b"D":
                        if docs is not None:
                            got, place = done()
                            yield got
                        if zlib.crc32(body[4:]) != struct.unpack_from("<I", body)[0]:
                            raise ValueError(f"an index of shard {name} is damaged")
                        (k,) = struct.unpack_from("<I", body, 4)
                        known = np.frombuffer(body, np.uint8, k, 8)
                        nums = np.frombuffer(body, "<i8", k, 8 + k).tolist()
                        docs = [(d if ok else None, n, c) for ok, d, n, c in zip(known.tolist(), nums, np.frombuffer(body, "<u8", k, 8 + 9 * k).tolist(), np.frombuffer(body, "<u4", k, 8 + 17 * k).tolist())]
                        parts = []
                    else:
                        parts.append(rans.decode(body, coder, threads)[1])
                if docs is not None:
                    yield done()[0]

    rows = stored(files.mapInArrow(run, fields), "decoded") if not with_ids else files.mapInArrow(run, fields)
    # One row a shard; shards follow one another in the order of their numbers.
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = checked(sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")))
    cols = ["doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return rows.join(before, "shard").select(*cols)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document, write the data set below path (default: the shared folder), read it back.

    Order is ascending doc_id, null ids first; rows that share an id follow each other in the order of a hash of
    their ids. A null or empty text is its end id alone. An empty table makes a data set without documents.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    vocabulary = max(end_id + 1, _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))
    tokens = stored(tokenize(docs, tokenizer, end_id, id_col, text_col), "ids", compression="zstd")
    write_tokens(tokens, path, vocabulary)
    drop_stored(tokens)
    return read_tokens(spark, path)
