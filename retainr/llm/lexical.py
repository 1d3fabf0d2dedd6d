"""Ranked lexical search (operator 13): hashed max-sketches bound the scores, exact rescoring stops at the threshold.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, with only A-Z lower-cased.  ``build`` reads the texts
once and stores for every document its number of terms n, its distinct terms (64-bit hashes, ascending) with their counts, and
its sketch.  A sketch has a power of two of coordinates, at least ``SPREAD`` times the distinct terms; a term falls on the one that its
hash names, and a coordinate holds the largest count of its terms (``FULL`` stands for that many or more).  For one document the impact of a term grows with its count alone, so the
coordinatewise maxima of the impacts are the impacts of these maxima, and one sketch serves every corpus statistic.

A search scans the stored table twice for a block of items (of at most ``BLOCK_TERMS`` terms): first it counts in how many documents each of their terms occurs; then every task
looks up all terms of all items in the sketches of a batch of documents, which gives each (item, document) an upper
bound of its score, and rescores an item's documents exactly, from the stored counts, in the order of descending bounds until
a bound is below the score of the k-th best document of that task.  Each task returns k rows for an item at most, and the best k of these are the result.  Nothing is dealt by a key, so no term, item
or group of equal documents gathers rows in one task.

With N documents that hold a term, L terms in all of them, a document's n, and df documents that hold a term, in 64-bit
integers: w = floor(1000 ln((2N+2)/(2df+1))), m = 100 - 25 + (25 n N) div L, impact(tf) = (1000000000 tf) div (1000 tf + 12 m), and
the score is the sum of w impact(tf) over the item's terms, repeats included.

Two different terms count as one only if they agree in a 64-bit hash.  Edge cases: null and empty texts have no terms; an item
without terms, or whose terms occur nowhere, gets no rows, nor do documents with score 0.  Equal scores are ranked by
ascending doc_id (null ids last), and rows that share an id are separate documents.  Rows that share an item_id are separate items with rows of
their own.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retainr.llm.blocks import BYTE_BASE, Block, signed, span_hashes, unsigned, utf8
from retainr.llm.shared import stored

K = 20
SPREAD = 8
FULL = 255
LEAST = 64
TEXT_BYTES = 1 << 20
BLOCK_TERMS = 1 << 16
BATCH_CELLS = 1 << 20  # sketch coordinates and bounds that a task holds at a time
CHUNK = 64
NO_ID = np.iinfo(np.int64).max

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_blocks(column: pa.Array, max_bytes: int = TEXT_BYTES) -> Iterator[Block]:
    """Blocks of consecutive whole texts, lower-cased, with their terms as words."""
    if not len(column):
        return
    data, off = utf8(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1), n)
        part = _LOWER[data[off[at]:off[to]]]
        offsets = off[at:to + 1] - off[at]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = _LETTER[part]
        # a term ends with its text, so the ends of texts are cut between letters that touch
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(part))])
        cuts = cuts[_LETTER[part[cuts - 1]] & _LETTER[part[cuts]]]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        yield Block(at, part, offsets, starts, ends, np.searchsorted(starts, offsets))
        at = to


def term_hashes(block: Block) -> np.ndarray:
    return span_hashes(block.data.astype(np.uint64) + np.uint64(1), block.starts, block.ends, BYTE_BASE)


def coordinates(distinct: int) -> int:
    """Size of the sketch of a document with that many distinct terms."""
    return 1 << max(LEAST.bit_length() - 1, (SPREAD * distinct - 1).bit_length())


def _index(batches):
    """(doc_id, n, terms, counts, sketch) of every text with a term."""
    for batch in batches:
        for b in term_blocks(batch.column(1)):
            h, row = term_hashes(b), b.row_of_word
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, np.int64)
            tf = np.diff(np.append(first, len(h))).astype(np.uint32)
            h, row = h[first], row[first]
            to = np.searchsorted(row, np.arange(len(b) + 1))
            held, sketches = np.flatnonzero(np.diff(to)), []
            for i in held:
                size = coordinates(int(to[i + 1] - to[i]))
                s = np.zeros(size, dtype=np.uint8)
                np.maximum.at(s, h[to[i]:to[i + 1]] & np.uint64(size - 1), np.minimum(tf[to[i]:to[i + 1]], FULL).astype(np.uint8))
                sketches.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(b.first, len(b)).take(pa.array(held)), pa.array(b.n_words[held]),
                 pa.array([h[to[i]:to[i + 1]].tobytes() for i in held], pa.binary()),
                 pa.array([tf[to[i]:to[i + 1]].tobytes() for i in held], pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "terms", "counts", "sketch"])


@dataclass
class Index:
    """Stored table (doc_id, n, terms, counts, sketch) of the documents with terms, their number and that of their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame) -> Index:
    table = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _index, "doc_id long, n long, terms binary, counts binary, sketch binary"), "lexical-index")
    sums = table.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(table, sums.docs, sums.terms)


@dataclass
class Items:
    """A block of items: their numbers, and for each the distinct terms (positions in ``vocabulary``) with their repeats."""

    numbers: list[int]
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, hashes: list[tuple[int, np.ndarray]]) -> Items:
        vocabulary = np.unique(np.concatenate([h for _, h in hashes]))
        each = [np.unique(h, return_counts=True) for _, h in hashes]
        return cls([i for i, _ in hashes], vocabulary, [np.searchsorted(vocabulary, h) for h, _ in each], [n for _, n in each])


def _item_blocks(items: DataFrame, block_terms: int) -> Iterator[Items]:
    """The items (number, text), partition by partition on the driver, in blocks."""
    held, n = [], 0
    for r in items.toLocalIterator():
        for b in term_blocks(pa.array([r.text], pa.string())):
            h = term_hashes(b)
            if not len(h):
                continue
            if held and n + len(h) > block_terms:
                yield Items.of(held)
                held, n = [], 0
            held.append((r.number, h))
            n += len(h)
    if held:
        yield Items.of(held)


def _holders(batches, vocabulary):
    """(term, n): documents of a task that hold each term of the vocabulary."""
    v = vocabulary.value
    n = np.zeros(len(v), dtype=np.int64)
    for batch in batches:
        data, _ = utf8(batch.column(0))
        h = data.view(np.uint64) if len(data) % 8 == 0 else np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        at = np.minimum(np.searchsorted(v, h), len(v) - 1)
        n += np.bincount(at[v[at] == h], minlength=len(v))
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["term", "n"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 12 * m, 1)


class _Best:
    """The k best documents of an item: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def bar(self) -> int:
        """Documents with a lower bound than this cannot be among the best."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc: int) -> None:
        entry = (score, -doc)
        if score > 0 and len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif score > 0 and entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


@dataclass
class _Docs:
    """Documents of a batch whose sketches have one size."""

    ids: np.ndarray
    m: np.ndarray
    sketch: np.ndarray  # coordinates x documents
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    def bounds(self, items: Items, weights: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each (item, document)."""
        at = (items.vocabulary & np.uint64(len(self.sketch) - 1)).astype(np.int64)
        used = np.flatnonzero(np.bincount(at, minlength=len(self.sketch)))
        # the impact of every coordinate that some term falls on; the fullest count stands for any larger one
        found = self.sketch[used]
        high = impacts(found, self.m[None, :])
        high[found == FULL] = 1_000_000
        row = np.zeros(len(self.sketch), dtype=np.int64)
        row[used] = np.arange(len(used))
        out = np.empty((len(items.terms), len(self.ids)), dtype=np.int64)
        for i, (terms, repeats) in enumerate(zip(items.terms, items.repeats, strict=True)):
            out[i] = (weights[terms] * repeats) @ high[row[at[terms]]]
        return out

    def scores(self, which: np.ndarray, vocabulary: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for an item's distinct terms (ascending) with their weights."""
        h = np.concatenate([self.terms[d] for d in which])
        of = np.repeat(np.arange(len(which)), [len(self.terms[d]) for d in which])
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == h)
        tf = np.concatenate([self.counts[d] for d in which])[hit]
        out = np.zeros(len(which), dtype=np.int64)
        np.add.at(out, of[hit], weights[at[hit]] * impacts(tf, self.m[which][of[hit]]))
        return out


def _batches_by_size(batch, n_docs: int, n_terms: int, n_items: int) -> Iterator[_Docs]:
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
    sizes = np.diff(utf8(batch.column(4))[1])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, BATCH_CELLS // (int(size) + n_items))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            pick = pa.array(some)
            terms, counts, sketch = (batch.column(c).take(pick).to_pylist() for c in (2, 3, 4))
            yield _Docs(ids[some], m[some], np.ascontiguousarray(np.frombuffer(b"".join(sketch), np.uint8).reshape(len(some), -1).T),
                        [np.frombuffer(t, np.uint64) for t in terms], [np.frombuffer(c, np.uint32) for c in counts])


def _best_documents(batches, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int, rescored=None):
    """(number, doc_id, score): the k best documents of one task for each item."""
    best = [_Best(k) for _ in items.numbers]
    for batch in batches:
        for docs in _batches_by_size(batch, n_docs, n_terms, len(items.numbers)):
            bounds = docs.bounds(items, weights)
            for i, b in enumerate(best):
                bound = bounds[i]
                candidates = np.flatnonzero(bound >= b.bar)
                candidates = candidates[np.argsort(-bound[candidates], kind="stable")]
                vocabulary, w = items.vocabulary[items.terms[i]], weights[items.terms[i]] * items.repeats[i]
                for lo in range(0, len(candidates), CHUNK):
                    chunk = candidates[lo:lo + CHUNK]
                    chunk = chunk[bound[chunk] >= b.bar]
                    if not len(chunk):
                        break
                    if rescored is not None:
                        rescored.add(len(chunk))
                    for s, d in zip(docs.scores(chunk, vocabulary, w).tolist(), docs.ids[chunk].tolist(), strict=True):
                        b.add(s, d)
    rows = [(n, -d, s) for n, b in zip(items.numbers, best, strict=True) for s, d in b.heap]
    number, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int64()), pa.array([None if d == NO_ID else d for d in doc], pa.int64()), pa.array(score, pa.int64())],
        ["number", "doc_id", "score"])


def search(index: Index, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the index with the highest scores for each row (item_id, text)."""
    spark = items.sparkSession
    numbered = stored(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "lexical-items")
    sc, found = spark.sparkContext, None
    for block in _item_blocks(numbered.select("number", "text"), block_terms) if index.n_docs else ():
        vocabulary = sc.broadcast(block.vocabulary)  # BLOCK_TERMS terms at most, or those of one item
        held = index.table.select("terms").mapInArrow(lambda b, v=vocabulary: _holders(b, v), "term long, n long")
        df = {r.term: r.n for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        # a term that no document holds can only meet other terms in a coordinate: without weight it tightens the bounds
        weights = np.array([weight(index.n_docs, df[t]) if t in df else 0 for t in range(len(block.vocabulary))], dtype=np.int64)
        shared, n, total = sc.broadcast((block, weights)), index.n_docs, index.n_terms
        rows = index.table.mapInArrow(
            lambda b, s=shared, n=n, total=total: _best_documents(b, *s.value, n, total, k), "number long, doc_id long, score long")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
