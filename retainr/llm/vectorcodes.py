"""Vector code compression (operator 11): integer product codes by limb-split exact matrix products.

A component x becomes the integer floor(``SCALE`` x).  A vector is cut into ``PARTS`` equal consecutive parts; each part
position has a codebook of ``ENTRIES`` integer vectors, which starts as that part of the vectors with the smallest ids.
Each of ``ROUNDS`` rounds assigns every part of every vector to the nearest entry of its codebook (squared Euclidean
distance, ties to the lower index) and replaces each entry by the componentwise floor of the mean of its parts; an entry
without parts stays.  A code is the index of the nearest final entry of each part.

Distances need exact dot products of integers, which a BLAS product of doubles gives only below 2**53.  So integers
are broken into limbs of ``LIMB`` bits (the lower limbs unsigned, the highest signed), a product runs over at most
``SLICE`` positions, and the dot products of limbs, all below 2**53, are shifted and added as 64-bit integers.  That
sum is right modulo 2**64, hence right, because the distances themselves fit.

The vectors are scanned once a round; a task returns the counts and sums of its parts by entry, which Spark adds up.
The driver holds the codebooks alone (``ENTRIES`` vectors, whatever the size of the table).

Edge cases: vectors that are null or hold null or non-finite components are dropped.  So are vectors that have no place
in the common codebooks: of another length than most (ties: the shorter), of a length that ``PARTS`` does not divide, or with a component so large
that a squared distance might not fit into 64 bits (beyond about 46,000 at 64 dimensions).  Rows with a null id are kept and come
last; rows that share an id are separate rows, ordered by their integers.  With fewer rows than ``ENTRIES`` the codebooks have one entry a
row.  Sums of errors that exceed 64 bits are null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainr.llm.shared import stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LIMB, SLICE = 20, 4096  # SLICE * 2**(2 * LIMB) < 2**53
BROADCAST_LABELS = 100_000


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """int64 as doubles d0, d1, ... with x = sum(d[i] << (LIMB * i)) and every |d| <= 2**LIMB."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, exact modulo 2**64."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for lo in range(0, x.shape[1], SLICE):
        right = [np.ascontiguousarray(b.T) for b in limbs(y[:, lo:lo + SLICE])]
        for i, a in enumerate(limbs(x[:, lo:lo + SLICE])):
            for j, b in enumerate(right):
                if LIMB * (i + j) < 64:
                    out += (a @ b).astype(np.int64) << (LIMB * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row and its squared distance."""
    d = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(axis=1)


@dataclass
class Codebooks:
    """``books[p, e]`` is entry e of part position p."""

    books: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def split(self, column: pa.Array) -> np.ndarray:
        """Rows of integers as (part position, row, position within the part)."""
        flat = np.asarray(column.flatten()).astype(np.int64, copy=False)
        return flat.reshape(len(column), len(self.books), -1).transpose(1, 0, 2)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Approximate vectors (in the original unit) of rows of part indexes."""
        parts = [self.books[p, codes[:, p]] for p in range(len(self.books))]
        return np.concatenate(parts, axis=1) / SCALE


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def integers(table: DataFrame, vec: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label"),
             parts: int = PARTS) -> DataFrame | None:
    """(*keep, x array<long>): the vectors that take part, as a stored table; None if there are none."""
    rows = table.select(*keep, F.col(vec).cast("array<double>").alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0)
        & F.coalesce(F.forall("x", _finite), F.lit(False)))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return None
    largest = math.sqrt(2.0 ** 61 / common[0].d) / SCALE
    fitting = rows.where((F.size("x") == common[0].d) & F.forall("x", lambda v: F.abs(v) <= largest))
    return stored(fitting.withColumn("x", F.transform("x", lambda v: F.floor(v * SCALE))), "vector-integers")


def _part_sums(batches, model: Codebooks):
    """(part, entry, position, n, total): counts and sums of the parts that one task assigns to each entry."""
    total, n = np.zeros_like(model.books), np.zeros(model.books.shape[:2], dtype=np.int64)
    for batch in batches:
        for p, x in enumerate(model.split(batch.column(0))):
            at, _ = nearest(x, model.books[p])
            n[p] += np.bincount(at, minlength=len(n[p]))
            for e in np.flatnonzero(np.bincount(at)):
                total[p, e] += x[at == e].sum(axis=0)
    p, e, j = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
    yield pa.RecordBatch.from_arrays(
        [pa.array(a) for a in (p, e, j, n[p, e], total[p, e, j])], ["part", "entry", "position", "n", "total"])


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> Codebooks | None:
    """Codebooks of the rows (vec_id, x) of ``integers``; None without rows."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return None
    start = np.array([r.x for r in first], dtype=np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        model = Codebooks(books.copy())
        sums = vectors.select("x").mapInArrow(
            lambda batches, m=model: _part_sums(batches, m), "part long, entry long, position long, n long, total long")
        # one row for each number of the codebooks, whatever the size of the table
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect():
            books[r.part, r.entry, r.position] = r.t // r.n
    return Codebooks(books)


def encode(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """The columns of ``vectors`` without x, with code (two hex digits a part) and error (squared distance, summed over the parts)."""
    kept = [f for f in vectors.schema.fields if f.name != "x"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "code string", "error long"])

    def run(batches):
        digits = np.array([f"{e:02x}" for e in range(256)])
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(x, model.books[p]) for p, x in enumerate(model.split(batch.column(0)))]
            code = digits[found[0][0]]
            for at, _ in found[1:]:
                code = np.char.add(code, digits[at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(code), pa.array(np.sum([d for _, d in found], axis=0))],
                [*(f.name for f in kept), "code", "error"])

    return vectors.select("x", *[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def compress(table: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the code of every vector that takes part, its error, and the
    errors summed over the rows with its label (null labels together)."""
    vectors = integers(table.select("vec_id", F.col(label).alias("label"), F.col(vec).alias("embedding")))
    model = fit(vectors) if vectors is not None else None
    if model is None:
        return table.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = stored(encode(vectors, model), "vector-codes")
    # a label may hold a third of the rows: errors are added up before the shuffle, and the sums of a checked
    # number of labels go to the rows; with more labels than that AQE deals out the rows of a hot one
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error",
        F.lit(model.digest).alias("codebooks_sha256"))
