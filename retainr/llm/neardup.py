"""Near duplicates (operator 8): circulant MinHash, banding, exact Jaccard.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased).  Two
permutations of the 32-bit integers make all signature coordinates: the first is applied to
each shingle hash, the second is shifted circularly by k for coordinate k, whose value is the
minimum over the set.  ``BANDS`` bands of ``ROWS`` coordinates find candidates; at a similarity of 0.85 the
chance that a pair shares no band is below 3e-7.  The curve is steep on purpose: texts that merely share a passage
(a similarity of 0.4, say) meet in a band in 1 of 70 cases, so they do not fill the buckets.

Equal sets are one class, so exact copies are one row.  Candidates are compared on their whole
sets:

* in each bucket every member with the smallest one (a star: as many pairs as members), and the
  confirmed links are closed into components;
* in buckets that still hold several components, shingles that a document shares with none of the documents left there
  bound its similarity from above; documents that cannot reach the threshold leave, and a second star joins the others to
  the member with the fewest shingles of its own;
* then the pairs of members of different components that are left and that the bound admits.  Pairs
  inside one component cannot change the result and are never made.

Edge cases: null or empty texts have no shingles and link with nothing; fewer than
``SHINGLE`` words are one shingle; rows without an id are linked with nothing and kept; rows that share an id
are one node; further columns pass through; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.llm import blocks as B
from retainr.llm.components import components
from retainr.llm.shared import stored

SHINGLE = 5
ROWS, BANDS = 9, 58
PERCENT = 85

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(block: B.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    block.data = _FOLD[block.data]
    hashes = block.word_hashes()
    at = block.windows(k)
    grams = B.span_hashes(hashes, at, at + k, B.WORD_BASE)
    n = block.n_words
    bounds = np.concatenate(([0], np.cumsum(np.maximum(n - k + 1, 0))))
    short = np.flatnonzero((n > 0) & (n < k))
    whole = B.span_hashes(hashes, block.words[short], block.words[short + 1], B.WORD_BASE)
    parts = [grams[bounds[i]:bounds[i + 1]] for i in range(len(block))]
    for i, h in zip(short.tolist(), whole, strict=True):
        parts[i] = np.array([h], dtype=B.U64)
    parts = [np.unique(p) for p in parts]
    return (np.concatenate(parts) if parts else grams), np.concatenate(
        ([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _permute(x: np.ndarray, tmp: np.ndarray) -> None:
    """A bijection of the 32-bit integers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 0)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n circulant MinHash coordinates of each non-empty set (rows: coordinates)."""
    first = (B.mix64(sets) >> B.U64(32)).astype(np.uint32)  # first permutation, of the hash's bits
    heads = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.empty((n, len(heads)), dtype=np.uint32)
    x, tmp = np.empty_like(first), np.empty_like(first)
    if len(heads):
        for k in range(n):
            np.add(first, np.uint32(k), out=x)  # the second permutation, shifted by k
            _permute(x, tmp)
            np.minimum.reduceat(x, heads, out=out[k])
    return out


def _describe(batches, k, rows, bands):
    for batch in batches:
        counts, low, high, keys = [], [], [], []
        for block in B.blocks(batch.column(1)):
            sets, bounds = shingle_sets(block, k)
            n = np.diff(bounds)
            counts.append(n)
            sig = signatures(sets, bounds, rows * bands).astype(B.U64)
            band = np.empty((bands, sig.shape[1]), dtype=B.U64)
            for j in range(bands):
                acc = np.full(sig.shape[1], j + 1, dtype=B.U64)
                for r in range(rows):
                    acc = B.mix64(acc * B.U64(B.BYTE_BASE) + sig[j * rows + r])
                band[j] = acc
            at = 0
            for i in range(len(block)):
                digest = hashlib.blake2b(sets[bounds[i]:bounds[i + 1]].tobytes(), digest_size=16).digest()
                a, b = np.frombuffer(digest, dtype=np.int64)
                low.append(a)
                high.append(b)
                if n[i]:
                    keys.append(B.signed(np.ascontiguousarray(band[:, at])))
                    at += 1
                else:
                    keys.append(None)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()),
            pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches, k):
    for batch in batches:
        for block in B.blocks(batch.column(1)):
            sets, bounds = shingle_sets(block, k)
            packed = [sets[bounds[i]:bounds[i + 1]].tobytes() for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)),
                                              pa.array(packed, pa.binary())], ["node", "shingles"])


def _similar(batches, percent):
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            p, q = np.frombuffer(x.as_buffer(), B.U64), np.frombuffer(y.as_buffer(), B.U64)
            both = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
            keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(
        lambda b: _similar(b, percent), "a long, b long")


def _exploded(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            nodes = np.repeat(np.asarray(part.column(0)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(np.concatenate(sets) if sets else nodes)], ["node", "shingle"])


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets with their components so far."""
    return members.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Only the buckets that hold several components."""
    keys = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return labelled.join(keys, "key", "left_semi")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS,
                    bands: int = BANDS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable over links,
    itself included) and kept (it is that document)."""
    docs = docs.select("doc_id", "text")
    about = stored(docs.mapInArrow(lambda b: _describe(b, k, rows, bands),
                                   "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "about")
    classes = about.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.select(F.explode("bands").alias("key"), "node", "n")
    shared = members.groupBy("key").agg(
        F.min(F.struct("node", "n")).alias("pivot"), F.max("node").alias("hi")).where("pivot.node < hi").drop("hi")
    members = stored(members.join(shared, "key"), "members")
    nodes = members.select("node").distinct()
    sets = stored(docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(
        lambda b: _sets(b, k), "node long, shingles binary"), "sets")

    def fits(m, n):  # the sizes alone rule out the other pairs
        return 100 * F.least(m, n) >= percent * F.greatest(m, n)

    star = members.where((F.col("pivot.node") != F.col("node")) & fits("pivot.n", "n")).select(
        F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(confirmed(star, sets, percent), "links")
    groups = stored(components(links), "groups")
    labelled = _mixed(_labelled(members.select("key", "node", "n", F.col("pivot.node").alias("first")), groups))
    # shingles that a document shares with any other one that could still be linked bound its similarities
    grams = sets.join(labelled.select("node").distinct(), "node", "left_semi").mapInArrow(
        _exploded, "node long, shingle long")
    common = grams.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    known = grams.join(common.select("shingle"), "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    labelled = labelled.join(known, "node")
    least = labelled.groupBy("key").agg(F.min("n").alias("least"))
    labelled = labelled.join(least, "key").where(
        100 * F.col("u") >= percent * (F.col("n") + F.greatest("least", "u") - F.col("u"))).drop("least")

    def near(u, v, m, n):
        most = F.least(u, v)
        return (100 * most >= percent * (F.col(m) + F.col(n) - most)) & fits(m, n)

    # a star again, around the member with the fewest shingles of its own
    best = _mixed(labelled).groupBy("key").agg(
        F.max(F.struct((F.col("u") - F.col("n")).alias("own"), (-F.col("node")).alias("minus"), "node", "n", "u", "c")).alias("p"))
    labelled = stored(labelled.join(best, "key"), "labelled")
    star = labelled.where("c != p.c").where(near("u", "p.u", "n", "p.n")).select(
        F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
    links = stored(links.unionByName(confirmed(star, sets, percent)), "links")
    groups = stored(components(links), "groups")
    # what is left: members of all but the largest component of a bucket against the others' members
    labelled = _mixed(_labelled(labelled.select("key", "node", "n", "u", "first", F.col("p.node").alias("second")), groups))
    main = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.max(F.struct("m", "c"))["c"].alias("main"))
    labelled = stored(labelled.join(main, "key"), "labelled")
    keys = labelled.groupBy("node").agg(F.collect_set("key").alias("keys"))
    labelled = labelled.where("node != second").join(keys, "node")
    stray = labelled.where("c != main").select(
        "key", *[F.col(x).alias(f"{x}_a") for x in ("node", "c", "n", "u", "keys")])
    other = labelled.select("key", "main", "first", *[F.col(x).alias(f"{x}_b") for x in ("node", "c", "n", "u", "keys")])
    # a pair is made once, in the first bucket that holds both
    rest = stray.join(other, "key").where(
        (F.col("c_a") != F.col("c_b")) & (F.col("first") != F.col("node_a")) & (F.col("first") != F.col("node_b"))
        & ((F.col("c_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))) & near("u_a", "u_b", "n_a", "n_b")
        & (F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b")))).select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more = stored(confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    of = classes.select("d1", "d2", "node").join(groups, "node", "left").select(
        "d1", "d2", F.coalesce("component", "node").alias("group"))
    out = about.select("doc_id", "n_shingles", "d1", "d2").join(of, ["d1", "d2"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(
        F.col("doc_id")))
    return out.select("doc_id", "n_shingles", found.alias("component_id"),
                      F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
