"""Substring dedup (operator 1): De Bruijn compaction over token k-mers.

Edges are windows of ``k`` words.  Windows that follow each other and share the smallest hash of
their inner ``ANCHOR``-grams (their anchor) travel as one row, so the graph has one node an anchor
and a label for it: the windows around it and the words before and after them.

1. Nodes: ``groupBy(anchor)`` with map-side minima and maxima tells which anchors occur in more than
   one document, and whether all occurrences have the same label (not branching).
2. A join returns that to the occurrences.  Documents with such nodes are read again from their
   source coordinates: consecutive nodes that do not branch are compacted into one path, because
   every occurrence of its first node runs through the whole path; at a branching node the windows stay
   single.  Each path or window carries its coordinates (document, first word, length) and a
   second, independent hash of the very words found there, which verifies it (96 bits in all).
3. ``groupBy(path)`` finds the first document of each verified path, a join marks the later ones,
   and each document drops the words that marked spans cover, plus windows repeated inside itself.

All keys are content hashes, minima and maxima are combined before each shuffle, and joins keep the
large side splittable, so a passage that a third of all documents share makes no large group.

Edge cases: null or empty texts have no words; fewer than ``k`` words are kept; a null id orders
after all others and such documents do not shadow one another; rows with the same id are one
document at the same place in the order (each keeps its own words, repeats inside each are removed);
further columns pass through; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.llm import blocks as B

K = 20
ANCHOR = 6
LAST = (1 << 63) - 1


class _Graph:
    """Anchors, labels and windows of one block of texts."""

    def __init__(self, block: B.Block, k: int):
        self.block, self.k = block, k
        self.hashes = hashes = block.word_hashes()
        self.at = block.windows(k)  # first word of each window
        n = len(hashes)
        grams = B.span_hashes(hashes, np.arange(max(n - ANCHOR + 1, 0)),
                              np.arange(ANCHOR, n + 1), B.WORD_BASE) if n >= ANCHOR else np.empty(0, B.U64)
        anchor = B.sliding_argmin(grams, k - ANCHOR + 1)[self.at] if len(self.at) else self.at
        row = block.row_of_word
        self.row = row[self.at] if len(self.at) else self.at
        # a node: consecutive windows of a text with the same anchor
        new = np.ones(len(self.at), dtype=bool)
        if len(self.at):
            new[1:] = (anchor[1:] != anchor[:-1]) | (self.row[1:] != self.row[:-1])
        self.first = np.flatnonzero(new)  # first window of each node
        self.count = np.diff(np.append(self.first, len(self.at)))
        self.node_row = self.row[self.first]
        self.node = grams[anchor[self.first]] if len(self.at) else grams[:0]
        begin = self.at[self.first]
        end = begin + self.count - 1 + k
        lo, hi = block.words[self.node_row], block.words[self.node_row + 1]
        before = np.where(begin > lo, hashes[np.maximum(begin - 1, 0)], B.U64(1)) if n else hashes
        after = np.where(end < hi, hashes[np.minimum(end, n - 1)], B.U64(2)) if n else hashes
        if len(begin):
            body = B.span_hashes(hashes, begin, end, B.WORD_BASE)
            self.label = B.mix64(B.mix64(body + before) ^ (after * B.U64(B.CHECK_BASE)) ^ (end - begin).astype(B.U64)
                                 ^ ((anchor[self.first] - begin).astype(B.U64) << B.U64(32)))
        else:
            self.label = grams[:0]

    def windows(self, base: int = B.WORD_BASE) -> np.ndarray:
        return B.span_hashes(self.hashes, self.at, self.at + self.k, base)

    def checks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Independent hash of the words found at these coordinates."""
        return B.span_hashes(B.mix64(self.hashes ^ B.U64(B.CHECK_BASE)), starts, ends, B.CHECK_BASE)


ROWS = 256  # documents that a task holds unpacked


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _nodes(batches, k):
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for block in B.blocks(batch.column(1)):
            g = _Graph(block, k)
            if len(g.node):
                # one row for each node of a text
                key = B.mix64(g.label + g.node_row.astype(B.U64) * B.U64(B.BYTE_BASE))
                keep = np.sort(np.unique(key, return_index=True)[1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(B.signed(g.node[keep])), pa.array(B.signed(g.label[keep])),
                    pa.array(ids[block.first + g.node_row[keep]])], ["node", "label", "ord"])


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in _slices(batches):
        texts = [pack.compress(x.as_buffer()) if x.is_valid else None
                 for x in batch.column(3).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(texts, pa.binary())], ["ord", "digest", "doc_id", "packed"])


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_buffer()) if x.is_valid else b"" for x in column], pa.large_binary())


def _paths(batches, k):
    for batch in _slices(batches):
        ids, digests = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        plain, branching = batch.column(4), batch.column(5)
        for block in B.blocks(_unpacked(batch.column(3))):
            g = _Graph(block, k)
            n = len(g.node)
            single, forked = np.zeros(n, bool), np.zeros(n, bool)
            bounds = np.searchsorted(g.node_row, np.arange(len(block) + 1))
            for i in range(len(block)):
                r, lo, hi = block.first + i, bounds[i], bounds[i + 1]
                for col, out in ((plain, single), (branching, forked)):
                    keys = col[r].values
                    if lo < hi and keys is not None and len(keys):
                        out[lo:hi] = np.isin(g.node[lo:hi], B.unsigned(np.asarray(keys)))
            # compact: consecutive nodes of a text that do not branch
            joined = np.zeros(n, bool)
            joined[1:] = single[1:] & single[:-1] & (g.node_row[1:] == g.node_row[:-1])
            heads = np.flatnonzero(single & ~joined)
            stop = np.flatnonzero(~joined)
            nxt = np.append(stop, n)[np.searchsorted(stop, heads, side="right")]
            starts = g.at[g.first[heads]] if n else heads
            wins = (np.append(g.first, len(g.at))[nxt] - g.first[heads]) if n else heads
            which = np.flatnonzero(np.repeat(forked, g.count)) if n else heads
            s = np.concatenate([starts, g.at[which]]) if n else starts
            w = np.concatenate([wins, np.ones(len(which), wins.dtype)]) if n else wins
            if not len(s):
                continue
            keys = np.concatenate([g.label[heads], g.windows()[which]])
            rows = np.concatenate([g.node_row[heads], g.row[which]])
            checks = g.checks(s, s + w + k - 1)
            local = s - block.words[rows]
            # once a text: its later repeats go anyway
            order = np.argsort(s, kind="stable")
            own = B.mix64(keys[order] + rows[order].astype(B.U64) * B.U64(B.BYTE_BASE))
            order = order[np.sort(np.unique(own, return_index=True)[1])]
            yield pa.RecordBatch.from_arrays([
                pa.array(B.signed(keys[order])), pa.array((checks[order] >> B.U64(32)).astype(np.uint32).view(np.int32)),
                pa.array(ids[block.first + rows[order]]), pa.array(digests[block.first + rows[order]]),
                pa.array(local[order].astype(np.int32)), pa.array(w[order].astype(np.int32))],
                ["path", "words", "ord", "digest", "start", "windows"])


def _kept(batches, k):
    for batch in _slices(batches):
        own, spans = np.asarray(batch.column(1)), batch.column(4)
        n_words, n_removed, digest, texts = [], [], [], []
        for block in B.blocks(_unpacked(batch.column(3))):
            g = _Graph(block, k)
            drop = np.zeros(len(block.starts) + 1, np.int64)
            # windows that started earlier in the same text
            key = B.mix64(g.windows() + g.row.astype(B.U64) * B.U64(B.BYTE_BASE))
            again = np.ones(len(key), bool)
            again[np.unique(key, return_index=True)[1]] = False
            np.add.at(drop, g.at[again], 1)
            np.add.at(drop, g.at[again] + k, -1)
            for i in range(len(block)):
                marked = spans[block.first + i].values
                if marked is not None and len(marked):
                    mine = np.asarray(marked.field("digest")) == own[block.first + i]
                    at = block.words[i] + np.asarray(marked.field("start")).astype(np.int64)[mine]
                    to = at + np.asarray(marked.field("windows"))[mine] + k - 1
                    np.add.at(drop, at, 1)
                    np.add.at(drop, to, -1)
            gone = np.cumsum(drop)[:-1] > 0
            for i in range(len(block)):
                lo, hi = block.words[i], block.words[i + 1]
                words = block.text_bytes(i).split()
                out = gone[lo:hi]
                left = b" ".join([x for x, y in zip(words, out.tolist(), strict=True) if not y] if out.any() else words)
                n_words.append(hi - lo)
                n_removed.append(int(out.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
        yield pa.RecordBatch.from_arrays([
            batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(digest, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _documents(docs: DataFrame) -> DataFrame:
    """(ord, digest, doc_id, packed): the texts as they travel, compressed."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("digest"),
                       "doc_id", "text").mapInArrow(
        _packed, "ord long, digest long, doc_id long, packed binary").where(
        "ord IS NOT NULL")  # said here, both joins see the same plan and share its exchange


def repeated_spans(docs: DataFrame, packed: DataFrame, k: int = K) -> DataFrame:
    """(ord, digest, start, windows): word spans of each document, ``windows`` + k - 1 words from word
    number ``start``, all of whose windows also occur in a document with a smaller id."""
    nodes = docs.select(F.coalesce("doc_id", F.lit(LAST)), "text").mapInArrow(
        lambda b: _nodes(b, k), "node long, label long, ord long")
    shared = nodes.groupBy("node").agg(
        F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("label").alias("a"), F.max("label").alias("z")
    ).where("lo < hi").select("node", (F.col("a") != F.col("z")).alias("branches"))
    seen = nodes.select("node", "ord").join(shared, "node").groupBy("ord").agg(
        F.collect_list(F.when(~F.col("branches"), F.col("node"))).alias("plain"),
        F.collect_list(F.when(F.col("branches"), F.col("node"))).alias("branching"))
    paths = packed.join(seen, "ord").select(*packed.columns, "plain", "branching").mapInArrow(
        lambda b: _paths(b, k), "path long, words int, ord long, digest long, start int, windows int")
    first = paths.groupBy("path", "words").agg(F.min("ord").alias("first"))
    return paths.join(first, ["path", "words"]).where("ord > first").select(
        "ord", "digest", "start", "windows")


def dedup_substrings(docs: DataFrame, k: int = K) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words
    joined by one space).  A word goes if a window of ``k`` words that covers it also starts earlier:
    in a document with a smaller id, or earlier in the same one."""
    packed = _documents(docs)  # both joins take it dealt by ord: one exchange of the texts
    marked = repeated_spans(docs, packed, k).groupBy("ord").agg(
        F.collect_list(F.struct("digest", "start", "windows")).alias("spans"))
    return packed.join(marked, "ord", "left").select(*packed.columns, "spans").mapInArrow(
        lambda b: _kept(b, k),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
