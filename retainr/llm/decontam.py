"""Benchmark decontamination (operator 3): pigeonhole edit matching.

An item of n words may be found with up to e = floor(n * ``ERROR_RATE``) word edits.  It is cut into
e + 1 pieces, so one piece is untouched wherever the item occurs; windows of a document that hash
like the first words of a piece are candidates, and Myers' bit-parallel algorithm computes
the edit distance of the item to the best place around each.  A document and an item are reported once, with the
fewest edits over all places, at the first place that has them.  Words are compared lower-cased, with ASCII
punctuation as blanks.

Test items are taken in blocks of at most ``BLOCK_BYTES`` of text; each block's index is sent to the
executors and all documents are scanned once a block, without a shuffle.

Edge cases: null or empty texts and items match nothing; items of few words allow no edit and match their
exact word sequence; repeated documents or items are reported each; a null id is reported as null;
further columns pass through ``decontaminate``; without items or documents nothing is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.llm import blocks as B

ERROR_RATE = 0.15
MAX_SEED = 6  # words of a piece that are hashed
BLOCK_BYTES = 8 << 20
FILTER_BITS = 20

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def clean_blocks(column) -> Iterator[B.Block]:
    """Blocks of normalised texts."""
    for first, part in B.parts(column):
        data, off = B.utf8(pc.utf8_lower(part.cast(pa.large_string())))
        data = _CLEAN[data[off[0]:off[-1]]]
        buffers = [pa.py_buffer(np.ascontiguousarray(off - off[0])), pa.py_buffer(data)]
        for block in B.blocks(pa.LargeStringArray.from_buffers(len(off) - 1, *buffers)):
            block.first += first
            yield block


def myers(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of a pattern (bit masks of its m words) to any part of ``text``, and the
    position after the first such part."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        x = masks.get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = (vn | ~(vp | d0)) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        x = (hp << 1) & full
        vn = x & d0
        vp = ((hn << 1) | ~(x | d0)) & full
        if score < best:
            best, end = score, j
    return best, end


class Index:
    """Pieces of a block of items, by the number of words hashed."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = ERROR_RATE):
        self.ids, self.masks, self.sizes, self.errors = [], [], [], []
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        ids = [i for i, _ in items]
        for block in clean_blocks(texts) if items else ():
            hashes = block.word_hashes()
            for row in range(len(block)):
                words = hashes[block.words[row]:block.words[row + 1]]
                n = len(words)
                if not n:
                    continue
                e = math.floor(n * rate)
                cuts = [round(i * n / (e + 1)) for i in range(e + 2)]
                q = min(MAX_SEED, *(b - a for a, b in zip(cuts, cuts[1:], strict=False)))
                which = len(self.ids)
                masks: dict[int, int] = {}
                for j, w in enumerate(words.tolist()):
                    masks[w] = masks.get(w, 0) | 1 << j
                self.ids.append(ids[block.first + row])
                self.masks.append(masks)
                self.sizes.append(n)
                self.errors.append(e)
                at = np.array(cuts[:-1])
                for h, a in zip(B.span_hashes(words, at, at + q, B.WORD_BASE).tolist(), cuts, strict=False):
                    seeds.setdefault(q, []).append((h, which, a))
        self.seeds = {}
        for q, rows in seeds.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], dtype=B.U64)
            marks = np.zeros(1 << FILTER_BITS, dtype=bool)
            marks[(keys >> B.U64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds[q] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), marks)

    def find(self, block: B.Block) -> Iterator[tuple[int, int, int, int, int]]:
        """(text of the block, item, edits, first word, word after) of each item found in each text."""
        hashes = block.word_hashes()
        proposals = []
        for q, (keys, which, offset, marks) in self.seeds.items():
            at = block.windows(q)
            grams = B.span_hashes(hashes, at, at + q, B.WORD_BASE)
            maybe = np.flatnonzero(marks[(grams >> B.U64(64 - FILTER_BITS)).astype(np.int64)])
            lo = np.searchsorted(keys, grams[maybe], side="left")
            n = np.searchsorted(keys, grams[maybe], side="right") - lo
            maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
            hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            proposals.append((which[hit], np.repeat(at[maybe], n), offset[hit]))
        if not proposals:
            return
        item, at, offset = (np.concatenate(x) for x in zip(*proposals, strict=True))
        row = np.searchsorted(block.words, at, side="right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        places = np.unique(np.stack([row, item, at - offset], axis=1), axis=0)
        for r, i, begin in places.tolist():
            if best.get((r, i), (1, 0))[0] == 0:  # an unchanged place, and places come in order
                continue
            e, n = self.errors[i], self.sizes[i]
            lo = max(int(block.words[r]), begin - e)
            hi = min(int(block.words[r + 1]), begin + n + e)
            edits, end = myers(self.masks[i], n, hashes[lo:hi].tolist())
            if edits <= e:
                place = edits, lo + end - int(block.words[r])
                best[r, i] = min(place, best.get((r, i), place))
        for (r, i), (edits, stop) in best.items():
            yield r, self.ids[i], edits, max(0, stop - self.sizes[i]), stop


def _item_blocks(benchmark: DataFrame, text: str) -> Iterator[Index]:
    """Indexes of bounded blocks of the items."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = math.ceil(size / BLOCK_BYTES)
    for i in range(n):
        part = F.pmod(F.xxhash64("item_id", text), F.lit(n)) == i
        yield Index([tuple(r) for r in benchmark.where(part).select("item_id", text).collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, first_word, end_word): one row for each document and each item found in it."""
    out = None
    for index in _item_blocks(benchmark, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                ids, rows = batch.column(0), []
                for block in clean_blocks(batch.column(1)):
                    rows += [(block.first + r, *rest) for r, *rest in shared.value.find(block)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in cols[1:]],
                    ["doc_id", "item_id", "edits", "first_word", "end_word"])

        part = docs.select("doc_id", text).mapInArrow(
            run, "doc_id long, item_id long, edits long, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, edits long, first_word long, end_word long")
    return out


def _clean_rows(batches, index: Index, at: int) -> Iterator[pa.RecordBatch]:
    """The rows in which no item is found, in batches of bounded size; the text is column ``at``."""
    for batch in batches:
        for first, part in B.parts(batch.column(at)):
            keep = np.ones(len(part), dtype=bool)
            for block in clean_blocks(part):
                for r, *_ in index.find(block):
                    keep[block.first + r] = False
            yield batch.slice(first, len(part)).filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    at = docs.columns.index(text)
    for index in _item_blocks(benchmark, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(lambda b, shared=shared: _clean_rows(b, shared.value, at), docs.schema)
    return docs
