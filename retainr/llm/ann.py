"""Approximate nearest neighbours (operator 6): balanced lists, a vector in one of them.

Centroids are fitted on about ``SAMPLE`` vectors (chosen by a hash of the id) with a size penalty that balances the
lists; there are about n / ``LIST`` of them, ``CENTROIDS`` at most.  Every vector of the table is indexed: it goes to its
nearest centroid.  A query reads every list whose centroid is within ``reach`` times the nearest distance, however
many these are.  The ratio is fitted on the table: one scan finds the true neighbours of ``ASKED`` vectors that
had no part in the centroids (where the table is larger than the sample), and ``RECALL`` of these lie in lists within it (``needed_reach``).
So recall does not fall as lists become more; few lists are read where vectors are clustered, and most of them where they have no
structure at all.  Beyond ``CENTROIDS`` x ``LIST`` vectors the lists grow with the table instead, and a query's cost with them.

Lists whose centroids lie together form a cell: about a ``CELLS``th of the table, at least ``BLOCK`` vectors, and no more than
``CELL`` bytes as estimated from the sample; a list beyond that is several cells.  One shuffle brings the vectors, each once, and
the queries, once for each cell that holds a list they read, to the cells.  A task holds the vectors of a cell and streams its
queries: a matrix product in single precision selects, within its rounding error, and the selected pairs are scored again in
double precision on the original vectors, so equal vectors score equally and ties go to the smaller id.  Disk is therefore the
table once and the queries times the cells they reach.  Queries that found fewer than k candidates read all lists.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; rows with a null id neither; of rows that share an id the one with the smallest vector counts (beyond ``BROADCAST_IDS``
such ids the table is stored without the others first); fewer than k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainr.llm.shared import stored

SAMPLE = 20_000
LIST = 160
CENTROIDS = 2048
RECALL, ASKED = 0.997, 1000
CELL, CELLS, BLOCK = 96 << 20, 48, 1024
PRODUCT, NARROW = 1 << 21, 128  # numbers in matrix products, columns of one: such products are the fastest
BROADCAST_IDS = 2_000_000
EPSILON, ROUGH = 1e-9, 1e-5  # of a distance, of the square of one in single precision
QUERY = (1 << 31) - 1  # in the place of a list: queries come after the vectors of a cell


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Graph:
    """Centroids and the cells of their lists."""

    centroids: np.ndarray
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # by list, its first cell
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # by list, how many cells it is dealt to
    reach: float = 1.0  # a query reads the lists within that ratio of its nearest one
    least: float = 0.0  # a nearest distance below that counts as that: a vector that is a centroid itself has no ratio

    def squares(self, x: np.ndarray, lists=slice(None)) -> np.ndarray:
        """Squared distances of unit vectors to centroids."""
        return np.maximum(2 - 2 * (x @ self.centroids[lists].T), 0)

    def limit(self, d: np.ndarray, ratio: float) -> np.ndarray:
        """How far the centroids may be that are within ``ratio`` times the nearest of the distances of each row."""
        if ratio == math.inf:
            return np.full((len(d), 1), math.inf)
        return ratio * np.maximum(d.min(axis=1, keepdims=True), self.least) + EPSILON

    def near(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance) of the centroids within ``ratio`` times the distance of a unit vector's nearest
        one, by row and distance."""
        d = np.sqrt(self.squares(x))
        r, c = np.nonzero(d <= self.limit(d, ratio))
        order = np.lexsort((c, d[r, c], r))
        return r[order], c[order], d[r, c][order]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each unit vector."""
        return (x @ self.centroids.T).argmax(axis=1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, limit): the cells that each unit vector's search reaches, and how far from it the lists are that it reads."""
        d = np.sqrt(self.squares(x))
        limit = self.limit(d, self.reach)
        r, c = np.nonzero(d <= limit)
        n = self.parts[c]
        cell = np.repeat(self.first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        count = int((self.first + self.parts).max())
        r, cell = np.divmod(np.unique(np.repeat(r, n) * count + cell), count)
        return r, cell, limit[r, 0]


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means whose assignment pays for the size of a cluster."""
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:k]].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        assigned = np.empty(len(x), dtype=np.int64)
        fee = 0.05 * (size / (len(x) / k) - 1)
        for i in range(0, len(x), 4096):
            assigned[i:i + 4096] = (x[i:i + 4096] @ c.T - fee).argmax(axis=1)
        size = np.bincount(assigned, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, assigned, x)
        empty = np.flatnonzero(size == 0)
        total[empty] = x[rng.integers(0, len(x), len(empty))]
        c = unit(total + 1e-12)
    return c


def cells(centroids: np.ndarray, sizes: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of each list: lists are halved across their widest direction until a cell holds ``most`` vectors at most; a
    single list beyond that is dealt to several cells."""
    first, parts, n, todo = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64), 0, [np.arange(len(sizes))]
    while todo:
        at = todo.pop()
        pieces = max(1, math.ceil(sizes[at].sum() / most))
        if pieces == 1 or len(at) == 1:
            first[at], parts[at] = n, pieces
            n += pieces
            continue
        x = centroids[at] - centroids[at].mean(axis=0)
        at = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        share = np.cumsum(sizes[at]) / sizes[at].sum()
        cut = int(np.clip(np.searchsorted(share, (pieces // 2) / pieces), 1, len(at) - 1))
        todo += [at[cut:], at[:cut]]
    return first, parts


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return unit(x.astype(np.float64)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, summed in the order of the components: it depends on the two rows only."""
    a, b = np.ascontiguousarray(a.T, dtype=np.float64), np.ascontiguousarray(b.T, dtype=np.float64)
    dot, aa, bb = np.zeros((3, a.shape[1]))
    for x, y in zip(a, b, strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Best:
    """The k best (score, key) of each of some queries so far; ties go to the smaller key."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.units, self.k = queries, _units(queries), k
        self.score, self.key = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), dtype=np.int64)
        self.slack = (queries.shape[1] + 4) * 2.0 ** -23  # of a cosine in single precision

    def add(self, rows: np.ndarray, vectors: np.ndarray, keys: np.ndarray, same=None) -> None:
        """Compares the queries of some rows with vectors; ``same`` says which of them (row, vector) are one and the same."""
        units, n = _units(vectors), -(-len(vectors) // NARROW)
        step = max(1, PRODUCT // (n * NARROW))
        space = np.empty((n, min(step, len(rows)), NARROW), dtype=np.float32)
        for lo in range(0, len(rows), step):
            r = rows[lo:lo + step]
            sim, left = space[:, :len(r)], self.units[r]
            for b in range(n):
                right = units[b * NARROW:(b + 1) * NARROW]
                if len(right) == NARROW:
                    np.matmul(left, right.T, out=sim[b])
                else:
                    sim[b, :, :len(right)], sim[b, :, len(right):] = left @ right.T, -np.inf
            if same is not None:
                i, j = same(r)
                sim[j // NARROW, i, j % NARROW] = -np.inf
            bar = (self.score[r, -1] - self.slack).astype(np.float32)
            self._raise(bar, sim, np.flatnonzero(bar == -np.inf))
            b, i = np.nonzero(sim.max(axis=2) >= bar)
            part = sim[b, i]
            at = np.flatnonzero(part >= bar[i, None])
            i, j, part = i[at // NARROW], b[at // NARROW] * NARROW + at % NARROW, part.ravel()[at]
            if len(at) > 2 * self.k * len(r):
                self._raise(bar, sim, np.flatnonzero(np.bincount(i, minlength=len(r)) > 2 * self.k))
            keep = (part >= bar[i]) & (part > -np.inf)
            i, j = i[keep], j[keep]
            if len(i):
                up, i = np.unique(i, return_inverse=True)
                r = r[up]
                self._merge(r, i, keys[j], np.concatenate([
                    cosines(self.queries[r[i[at:at + 8192]]], vectors[j[at:at + 8192]]) for at in range(0, len(i), 8192)]))

    def _raise(self, bar: np.ndarray, sim: np.ndarray, which: np.ndarray) -> None:
        """Raises some bars to what the k best of these vectors reach."""
        if len(which):
            wide = sim[:, which].transpose(1, 0, 2).reshape(len(which), -1)
            kth = np.partition(wide, -self.k, axis=1)[:, -self.k] if wide.shape[1] > self.k else np.float32(-np.inf)
            bar[which] = np.maximum(bar[which], kth - np.float32(2 * self.slack))

    def _merge(self, rows: np.ndarray, i: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        i = np.concatenate([i, np.repeat(np.arange(len(rows)), self.k)])
        keys, scores = np.concatenate([keys, self.key[rows].ravel()]), np.concatenate([scores, self.score[rows].ravel()])
        order = np.lexsort((keys, -scores, i))
        order = order[np.searchsorted(i[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.score[rows], self.key[rows] = scores[order], keys[order]

    def found(self, names: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays(
            [pa.array(names[i], pa.int64()), pa.array(self.key[i, j]), pa.array(self.score[i, j])], ["query_id", "vec_id", "score"])


def needed_reach(vectors: DataFrame, graph: Graph, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[float, float]:
    """(reach, least): the ratio at which ``RECALL`` of the k nearest vectors of some vectors of the table are in a list that is
    read, and the median of their distances to the nearest list."""
    shared = vectors.sparkSession.sparkContext.broadcast((graph, ids, asked))

    def run(batches):
        graph, ids, asked = shared.value
        best, rows = Best(asked, k), np.arange(len(asked))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x, own = _matrix(part.column(1)), _Ids(np.asarray(part.column(0)))
                best.add(rows, x, graph.home(_units(x)), lambda r, own=own: own.of(ids[r]))
        yield best.found(rows)

    near = vectors.mapInArrow(run, "query_id long, vec_id long, score double")
    found = np.array([(r.query_id, r.vec_id) for r in _ranked(near, k).collect()], dtype=np.int64).reshape(-1, 2)
    away = np.sqrt(graph.squares(_units(asked)))
    least = float(np.median(away.min(axis=1)))
    if not len(found):
        return 1.0, least
    away /= np.maximum(away.min(axis=1, keepdims=True), least) + EPSILON
    return float(np.quantile(away[found[:, 0], found[:, 1]], RECALL)), least


class _Ids:
    """Finds ids among those of some vectors, which differ."""

    def __init__(self, ids: np.ndarray):
        self.order = np.argsort(ids)
        self.sorted = ids[self.order]

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.sorted, ids), len(self.sorted) - 1)
        i = np.flatnonzero(self.sorted[at] == ids)
        return i, self.order[at[i]]


def _routed(vectors: DataFrame, asked: DataFrame, shared, kind: str) -> DataFrame:
    """The vectors, each in the cell of its list, and the queries in every cell that holds a list they read."""

    def rows(cell, at, part, limit):
        return pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(at.astype(np.int32)), *part, pa.array(limit, pa.float64())],
            ["cell", "list", "vec_id", "vec", "limit"])

    def homes(batches):
        graph = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                at = graph.home(_units(_matrix(part.column(1))))
                deal = np.asarray(part.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield rows(graph.first[at] + deal.astype(np.int64) % graph.parts[at], at, part.columns, np.zeros(len(at)))

    def visits(batches):
        graph = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                r, cell, limit = graph.visits(_units(_matrix(part.column(1))))
                yield rows(cell, np.full(len(r), QUERY), [c.take(pa.array(r)) for c in part.columns], limit)

    schema = f"cell int, list int, vec_id long, vec array<{kind}>, limit double"
    return vectors.mapInArrow(homes, schema).unionByName(asked.mapInArrow(visits, schema))


def first_of_equals(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows without those whose vector ``most`` rows of smaller ids have too: no query can need them."""
    bits, h = vectors.view(np.uint32), np.empty(len(ids), dtype=np.uint64)
    odd = np.random.default_rng(13).integers(0, 1 << 63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for lo in range(0, len(ids), 8192):
        h[lo:lo + 8192] = (bits[lo:lo + 8192] * odd).sum(axis=1)
    order = np.lexsort((ids, h))
    start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    start = np.repeat(start, np.diff(np.append(start, len(ids))))
    late = np.flatnonzero(np.arange(len(ids)) - start >= most)
    drop = [late[lo:lo + 8192][(bits[order[late[lo:lo + 8192]]] == bits[order[start[late[lo:lo + 8192]]]]).all(axis=1)]
            for lo in range(0, len(late), 8192)]
    return np.sort(np.delete(order, np.concatenate(drop))) if drop else np.arange(len(ids))


def _search(batches, shared, k: int):
    """(query_id, vec_id, score): the k best vectors of a cell for each query that reaches it; rows come by cell, the vectors by list and
    before the queries."""
    graph, now, held, pieces = shared.value, None, [], []

    def close():
        """Puts the pieces of the last list together, and cuts it into blocks: the first one a query meets gives it a bar for the others."""
        if pieces:
            ids, x = np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces])
            keep = first_of_equals(ids, x, k + 1)
            ids, x = (ids[keep], x[keep]) if len(keep) < len(ids) else (ids, x)
            held.extend((pieces[0][0], _Ids(ids[lo:lo + BLOCK]), ids[lo:lo + BLOCK], x[lo:lo + BLOCK]) for lo in range(0, len(ids), BLOCK))
            pieces.clear()

    for batch in batches:
        cell, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        runs = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        for lo, hi in zip(runs, np.append(runs[1:], len(cell)), strict=True):
            if cell[lo] != now:
                close()
                held.clear()
                now = cell[lo]
            part = batch.slice(lo, hi - lo)
            ids, x = np.asarray(part.column(2)), _matrix(part.column(3))
            if pieces and pieces[0][0] != at[lo]:
                close()
            if at[lo] != QUERY:
                pieces.append((at[lo], ids.copy(), x.copy()))
            elif held:
                best = Best(x, k)
                reads = graph.squares(best.units, [b[0] for b in held]) <= np.asarray(part.column(4))[:, None] ** 2 + ROUGH
                for (_, own, keys, vectors), rows in zip(held, reads.T, strict=True):
                    best.add(np.flatnonzero(rows), vectors, keys, lambda r, own=own, ids=ids: own.of(ids[r]))
                yield best.found(ids)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def build(vectors: DataFrame, n: int, size: int = LIST, neighbours: int = 5) -> Graph | None:
    """Centroids of the table (vec_id, vec) of n rows, fitted on the sample, their cells and the reach."""
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(1 << 40))
    rows = sorted(tuple(r) for r in vectors.where(draw < int(min(1.0, (SAMPLE + ASKED) / n) * (1 << 40))).select(
        draw, "vec", "vec_id").limit(2 * SAMPLE).collect())
    raw, ids = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.int64)
    x = unit(raw)
    if n > SAMPLE:  # asked are vectors that have no part in the centroids, as most queries have none
        x, asked = x[:-ASKED], np.arange(len(x))[-ASKED:]
    else:
        asked = np.random.default_rng(7).permutation(len(x))[:ASKED]
    k = max(1, min(CENTROIDS, round(n / size), len(x)))
    graph = Graph(balanced_centroids(x, k).astype(np.float32))
    at = np.concatenate([graph.home(x[lo:lo + 4096].astype(np.float32)) for lo in range(0, len(x), 4096)])
    bytes_each = raw.shape[1] * (4 if dict(vectors.dtypes)["vec"] == "array<float>" else 8)
    most = min(max(BLOCK, n / CELLS), max(1, CELL / bytes_each))
    graph.first, graph.parts = cells(graph.centroids, (np.bincount(at, minlength=k) + 0.5) * n / (len(x) + k / 2), most)
    graph.reach, graph.least = needed_reach(vectors, graph, ids[asked], raw[asked], neighbours)
    return graph


def _once(vectors: DataFrame, rows: int, ids: int) -> DataFrame:
    """One vector an id: the smallest."""
    if rows == ids:
        return vectors
    counts = vectors.groupBy("vec_id").count()
    twice = stored(counts.where(F.col("count") > 1).select("vec_id"), "repeated")
    if twice.count() > BROADCAST_IDS:
        return stored(vectors.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    again = vectors.join(F.broadcast(twice), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return vectors.join(F.broadcast(twice), "vec_id", "left_anti").unionByName(stored(again, "vectors"))


def search(table: DataFrame, queries: Column, k: int = 5, vec: str = "embedding", size: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that ``queries`` selects; lists hold about
    ``size`` vectors."""
    kind = "float" if dict(table.dtypes)[vec] == "array<float>" else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast(f"array<{kind}>").alias("vec")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d"), "vec_id").count().groupBy("d").agg(
        F.sum("count").alias("rows"), F.count(F.lit(1)).alias("ids")).orderBy(F.desc("rows"), "d").limit(1).collect()
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = _once(rows.where(F.size("vec") == sizes[0].d), sizes[0].rows, sizes[0].ids)
    graph = build(vectors, sizes[0].ids, size, k)
    asked = vectors.where(queries)

    def found(asked: DataFrame, graph: Graph) -> DataFrame:
        shared = table.sparkSession.sparkContext.broadcast(graph)
        routed = _routed(vectors, asked, shared, kind).repartition("cell").sortWithinPartitions("cell", "list")
        return _ranked(routed.mapInArrow(lambda b: _search(b, shared, k), "query_id long, vec_id long, score double"), k)

    first = stored(found(asked, graph), "found")
    enough = first.groupBy("query_id").count().where(F.col("count") >= k)
    short = asked.select("vec_id").join(enough, asked.vec_id == enough.query_id, "left_anti").select("vec_id")
    if short.isEmpty():
        return first
    every = found(asked.join(short, "vec_id"), replace(graph, reach=math.inf))
    return first.join(enough, "query_id", "left_semi").unionByName(every)
