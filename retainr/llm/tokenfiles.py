"""Token-ID output (operator 12): frequency-ranked ids in byte-aligned variable-length files.

Texts are encoded by a tokenizer file, an end id follows each document, and the ids are counted over the whole corpus:
rank 0 is the most frequent id (ties: the smaller id), so frequent ids take one byte.  A file is a row of blocks of whole documents:

    header    magic, bytes of the block, documents, ids                 4 x uint32
    doc ids   int64 each;  1 byte each: whether the id is null
    lengths   uint32 each: ids of the document
    control   2 bits an id: bytes of its rank less one, 4 ids a byte, lowest bits first
    data      the ranks, 1 to 4 bytes each, lowest byte first
    end       one line feed

all little-endian.  Control bytes stand apart from the data, so a block is decoded by looking up every control byte in a
table of four lengths and adding these up.  Documents are in ascending order of doc_id (null ids first) through the files, which the number in a
file's name orders.  Spark writes them (its text writer puts out the bytes as they are) and reads them whole, so they may lie in any store; a
file holds about ``SHARD_BYTES``.

Where the tokenizer file says that nothing crosses white space (``splits_at_spaces``), the tokenizer encodes each
distinct word once (``Encoder``) and the ids are put together; otherwise it encodes text by text.

Workers get batches of about ``BATCH_BYTES`` and make arrays for blocks of texts or ids, so a task holds no more where texts are longer.

Documents are dealt by ranges of (doc_id, hash of the ids, row number), so that an id, or no id, that a third of all rows share is cut
like any other range.

Edge cases: a null or empty text, or one of white space only, is the end id alone.  Very long texts are encoded whole and are a block of their own.
Rows that share an id stand side by side, ordered by a hash of their ids.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainr.llm.blocks import Block, blocks, parts
from retainr.llm.shared import arrow_batches, shared_dir, stored

END_ID = 1
MAGIC = 0x314B4F54
SHARD_BYTES = 8 << 20
BLOCK_IDS = 1 << 16
BATCH_BYTES = 4 << 20
TEXT_BYTES = 2 * BATCH_BYTES  # a batch is over its limit by a row
CACHE = 1 << 19
CHUNK = 2000
SHARDS_A_GROUP = 1024

# lengths of the four ids of each control byte
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    v = values.astype(np.uint32)
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    four[:len(v)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    lengths = extra.astype(np.int64) + 1
    at = np.cumsum(lengths) - lengths
    data = np.empty(int(lengths.sum()), dtype=np.uint8)
    data[at] = v & 0xFF
    for k in range(1, 4):
        more = np.flatnonzero(extra >= k)
        data[at[more] + k] = (v[more] >> (8 * k)) & 0xFF
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of ``pack``."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    body = b"".join([
        np.array([i or 0 for i in ids], dtype="<i8").tobytes(), bytes(i is None for i in ids),
        lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])
    return np.array([MAGIC, len(body), len(ids), len(ranks)], dtype="<u4").tobytes() + body


def read_blocks(content: bytes | memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ranks) of the blocks of a file."""
    whole = np.frombuffer(content, dtype=np.uint8)
    at = 0
    while at < len(whole):
        magic, size, docs, n = (int(x) for x in whole[at:at + 16].view("<u4"))
        if magic != MAGIC or at + 16 + size >= len(whole):
            raise ValueError(f"no block of token ids at byte {at}")
        body = whole[at + 16:at + 16 + size]
        numbers, null, lengths = body[:8 * docs].view("<i8"), body[8 * docs:9 * docs], body[9 * docs:13 * docs].view("<u4")
        ids = [None if z else i for i, z in zip(numbers.tolist(), null.tolist(), strict=True)]
        to = 13 * docs + -(-n // 4)
        yield ids, lengths.astype(np.int64), unpack(body[13 * docs:to], body[to:], n)
        at += 16 + size + 1  # the line feed


def splits_at_spaces(tokenizer: str) -> bool:
    """Whether the tokenizer file encodes a text as its words one after the other: steps before the model that look at
    single characters or at matches without white space, no added token with white space in or around it, and nothing after the model."""
    t = json.loads(tokenizer)

    def steps(part, name):
        part = part or {}
        return part.get(name, [part]) if part.get("type") == "Sequence" else [part]

    before = steps(t.get("normalizer"), "normalizers")
    cut = steps(t.get("pre_tokenizer"), "pretokenizers")
    plain = all(s.get("type") in ("NFC", "Lowercase") or (
        s.get("type"), s.get("pattern"), s.get("content")) == ("Replace", {"Regex": "\\s+"}, " ") for s in before)
    # a removing, inverted split keeps the matches alone; these classes and literals match no white space
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    first = cut[0].get("type") == "Split" and cut[0].get("pattern") == {"Regex": pattern} and (
        cut[0].get("behavior"), cut[0].get("invert")) == ("Removed", True)
    rest = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex", True)
               for s in cut[1:])
    added = all(not a.get("lstrip") and not a.get("rstrip") and not a.get("single_word")
                and not any(c.isspace() for c in a["content"]) for a in t.get("added_tokens", []))
    return plain and first and rest and added and not t.get("truncation") and not t.get("padding")


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Values one after the other and the offsets of the lists."""
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(offsets[-1])), offsets


def _gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` one after the other, and their lengths."""
    n = np.diff(offsets)[which]
    to = np.cumsum(n)
    return values[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(offsets[which] - (to - n), n)], n


# Bytes of a piece that is one word for the tokenizer's split: ASCII letters and, as UTF-8, the letters U+00C0 to U+00FF, ...
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_LATIN = 0xC3
_LATIN_TAIL = np.zeros(256, dtype=bool)
_LATIN_TAIL[0x80:0xC0] = True
_LATIN_TAIL[[0x97, 0xB7]] = False  # the signs for times and divided by
# ... or marks alone, which end many words.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_NO_SPACE = np.ones(256, dtype=bool)
_NO_SPACE[[0x20, *range(0x09, 0x0E)]] = False


class Encoder:
    """Token ids of the texts of a column.

    Words are cut once more, into letters and the marks after them, which the tokenizer splits as well; distinct pieces are encoded
    many at a time, put together with blanks, and taken apart again after the tokens that end a word.  Any other word is
    encoded on its own.  Pieces that were encoded are kept, ``CACHE`` of them."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(tokenizer), splits_at_spaces(tokenizer)
        model = json.loads(tokenizer)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 2, dtype=bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.pool, self.offsets = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of the pieces; a simple one is one word for the tokenizer."""
        if simple and self.ends.any():
            ids = np.array(self._encode([" ".join(words)])[0], dtype=np.uint32)
            ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        ids, offsets = _ragged(self._encode(words))
        return ids, np.diff(offsets)

    def _places(self, words: pa.Array, simple: np.ndarray) -> np.ndarray:
        """Where each of some distinct pieces stands in the pool."""
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        if len(self.known) + int((at < 0).sum()) > CACHE:
            self._forget()
            at[:] = -1
        ids, lengths = [self.pool], [np.empty(0, dtype=np.int64)]
        order = [np.flatnonzero((at < 0) & (simple == kind)) for kind in (True, False)]
        for kind, new in zip((True, False), order, strict=True):
            for lo in range(0, len(new), CHUNK):
                some = words.take(pa.array(new[lo:lo + CHUNK])).cast(pa.large_string()).to_pylist()
                i, n = self._pieces(some, kind)
                ids.append(i)
                lengths.append(n)
        new = np.concatenate(order)
        at[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, words.take(pa.array(new))])
        self.pool = np.concatenate(ids)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(lengths))])
        return at

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) for blocks of consecutive rows."""
        if not self.by_word:
            for lo in range(0, len(column), 64):
                yield lo, *_ragged(self._encode([t or "" for t in column[lo:lo + 64].to_pylist()]))
            return
        for at, texts in parts(column, TEXT_BYTES):
            cut = [(b.first, *_pieces(b)) for b in blocks(texts)]
            distinct = pa.concat_arrays([pieces for _, pieces, _, _ in cut]).dictionary_encode()
            cut = [(first, simple, to) for first, _, simple, to in cut]
            which, words = np.asarray(distinct.indices), distinct.dictionary
            kinds = np.zeros(len(words), dtype=bool)
            kinds[which] = np.concatenate([simple for _, simple, _ in cut])
            places = self._places(words, kinds)
            done = 0
            for first, simple, to in cut:
                ids, n = _gather(self.pool, self.offsets, places[which[done:done + len(simple)]])
                done += len(simple)
                so_far = np.zeros(len(n) + 1, dtype=np.int64)
                np.cumsum(n, out=so_far[1:])
                yield at + first, ids, so_far[to]


def _pieces(b: Block) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Pieces of a block's words, whether each is simple, and the bounds of the texts among them."""
    starts, ends, simple, word = _cut(b.data, b.starts, b.ends)
    letters = _LOWER[b.data]
    odd = np.flatnonzero(~simple)  # lower-cased by the tokenizer alone, which looks for special tokens first
    at, _ = _gather(np.arange(len(b.data)), np.stack([starts[odd], ends[odd]], axis=1).ravel(), 2 * np.arange(len(odd)))
    letters[at] = b.data[at]
    letters = letters[_NO_SPACE[b.data]]
    to = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=to[1:])
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(letters))])
    return pieces, simple, np.searchsorted(word, b.words)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of words, whether each is simple, and its word."""
    plain = _ASCII_LETTER[data]
    lead = np.flatnonzero(data[:-1] == _LATIN)
    lead = lead[_LATIN_TAIL[data[lead + 1]]]
    plain[lead] = plain[lead + 1] = True
    odd = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(~plain, out=odd[1:])
    # a word's letters end after its last byte that is no mark
    last = np.where(_MARK[data], -1, np.arange(len(data), dtype=np.int32))
    last = np.maximum.accumulate(last) if len(data) else last
    middle = np.maximum(last[ends - 1] + 1, starts) if len(ends) else ends
    letters = odd[middle] == odd[starts]
    middle = np.where(letters, middle, ends)  # any other word stays whole
    s, e = np.stack([starts, middle], axis=1).ravel(), np.stack([middle, ends], axis=1).ravel()
    simple, word = np.repeat(letters, 2), np.repeat(np.arange(len(starts)), 2)
    some = e > s
    return s[some], e[some], simple[some], word[some]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer: str) -> Encoder:
    """The encoder of this worker process, made once for its tasks."""
    key = hash(tokenizer)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer)
    return _ENCODERS[key]


def _tokenized(docs: DataFrame, tokenizer, end_id: int, width: int) -> DataFrame:
    """(doc_id, n, ids): ids of every document with its end id, as little-endian integers of ``width`` bytes."""

    def run(batches):
        for batch in batches:
            encoder = _encoder(tokenizer.value)
            for first, ids, offsets in encoder.encode(batch.column(1)):
                rows = len(offsets) - 1
                ended = np.insert(ids, offsets[1:], end_id).astype(f"<u{width}")
                to = (offsets + np.arange(rows + 1)) * width
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(np.diff(to) // width),
                     pa.LargeBinaryArray.from_buffers(
                         pa.large_binary(), rows, [None, pa.py_buffer(to), pa.py_buffer(ended)]).cast(pa.binary())],
                    ["doc_id", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, n long, ids binary")


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """The ids of all rows, one after the other."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, dtype=f"<u{width}")
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]].view(f"<u{width}")


def _frequencies(batches, width: int, size: int):
    n = np.zeros(size, dtype=np.int64)
    for batch in batches:
        flat = _flat(batch.column(0), width)
        for lo in range(0, len(flat), BLOCK_IDS):  # counting makes 8 bytes of each id
            n += np.bincount(flat[lo:lo + BLOCK_IDS], minlength=size)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["id", "n"])


def _packed(batches, rank_of, width: int):
    """(block): the documents of a sorted partition as blocks of the file format."""
    ranks = rank_of.value
    ids, lengths, held, n = [], [], [], 0

    def block():
        return pa.RecordBatch.from_arrays(
            [pa.array([write_block(ids, np.array(lengths), ranks[np.concatenate(held)])], pa.binary())], ["block"])

    for batch in batches:
        flat = _flat(batch.column(1), width)
        at = 0
        for doc, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if ids and n + size > BLOCK_IDS:
                yield block()
                ids, lengths, held, n = [], [], [], 0
            ids.append(doc)
            lengths.append(size)
            held.append(flat[at:at + size].copy())
            at, n = at + size, n + size
    if ids:
        yield block()


@dataclass
class TokenFiles:
    """Files of a corpus: ``path``/shards holds the blocks, ``path``/ranks the Parquet table (rank, id, n)."""

    spark: SparkSession
    path: str

    def ids_by_rank(self) -> np.ndarray:
        """The id of each rank: as many numbers as the tokenizer has ids at most."""
        rows = self.spark.read.schema("rank long, id long").parquet(f"{self.path}/ranks").collect()
        out = np.zeros(len(rows), dtype=np.uint32)
        for r in rows:
            out[r["rank"]] = r["id"]
        return out

    def _map(self, each, schema: str) -> DataFrame:
        ids = self.spark.sparkContext.broadcast(self.ids_by_rank())

        def run(batches):
            for batch in batches:
                for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    before = 0
                    for docs, lengths, ranks in read_blocks(content.as_buffer()):
                        yield each(shard, before, docs, lengths, ids.value[ranks])
                        before += len(ranks)

        number = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("shard")
        return self.spark.read.format("binaryFile").load(f"{self.path}/shards").where("length > 0").select(
            number, "content").mapInArrow(run, schema)

    def documents(self) -> DataFrame:
        """(doc_id, shard, at, ids array<int>): the ids of every document, and how many of its file are before it."""

        def each(shard, before, docs, lengths, ids):
            to = np.concatenate([[0], np.cumsum(lengths)])
            lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.astype(np.int32)))
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([shard] * len(docs), pa.int64()), pa.array(before + to[:-1]), lists],
                ["doc_id", "shard", "at", "ids"])

        return self._map(each, "doc_id long, shard long, at long, ids array<int>")

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document."""

        def each(shard, before, docs, lengths, ids):
            to = np.concatenate([[0], np.cumsum(lengths)])
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([shard] * len(docs), pa.int64()), pa.array(before + to[:-1]),
                 pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

        with arrow_batches(self.spark, BATCH_BYTES):
            found = stored(
                self._map(each, "doc_id long, shard long, at long, n_tokens long, ids_crc32 long"), "token-digests")
        # ids before each file: files are summed in groups first, so the one window without a key holds one row for 1,024 files
        group = F.floor(F.col("shard") / SHARDS_A_GROUP)
        files = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", group)
        groups = files.groupBy("group").agg(F.sum("n").alias("g")).select(
            "group", (F.sum("g").over(Window.orderBy("group")) - F.col("g")).alias("groups_before"))
        inside = F.sum("n").over(Window.partitionBy("group").orderBy("shard")) - F.col("n")
        starts = files.withColumn("inside", inside).join(groups, "group").select(
            "shard", (F.col("inside") + F.col("groups_before")).alias("file_start"))
        return found.join(starts, "shard").select(
            "doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None,
          shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encode the texts of (doc_id, text) and write them to ``path`` (default: a new folder in the shared one)."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _write(docs, tokenizer_path, end_id, path, shard_bytes)


def _write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None, shard_bytes: int) -> TokenFiles:
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/retainr-llm/token-files-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    model = json.loads(text)
    ids = [*model["model"]["vocab"].values(), *(a["id"] for a in model.get("added_tokens", [])), end_id]
    size = max(ids) + 1
    width = 2 if size <= 1 << 16 else 4
    tokenizer = spark.sparkContext.broadcast(text)
    tokens = stored(_tokenized(docs.select(F.col("doc_id").cast("long"), "text"), tokenizer, end_id, width).withColumn(
        "row", F.monotonically_increasing_id()), "token-ids")
    counts = tokens.select("ids").mapInArrow(lambda b: _frequencies(b, width, size), "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).collect()  # a row for each id of the tokenizer at most
    ranked = sorted((-r.n, r.id) for r in counts)
    spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(ranked)], "rank long, id long, n long").coalesce(
        1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(size, dtype=np.uint32)
    for k, (_, i) in enumerate(ranked):
        rank_of[i] = k
    bytes_ = sum(-n * (1.25 + (k > 0xFF) + (k > 0xFFFF)) for k, (n, _) in enumerate(ranked))
    shared = spark.sparkContext.broadcast(rank_of)
    dealt = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(
        max(1, int(-(-bytes_ // shard_bytes))), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    packed = dealt.select("doc_id", "ids", "n").mapInArrow(lambda b: _packed(b, shared, width), "block binary")
    packed.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option(
        "maxRecordsPerFile", 0).option("compression", "none").text(f"{path}/shards")
    return TokenFiles(spark, path)
