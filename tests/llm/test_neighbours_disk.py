"""Operator 6: what it leaves on disk, and the parts that keep it small."""

import os
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from retainr.llm import ann
from retainr.llm.shared import shared_dir


def _bytes(spark):
    """Shuffle and spill files and stored tables of a local session."""
    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    tops = [d.getPath() for d in own] + [shared_dir(spark).removeprefix("file:")]
    total = 0
    for top in tops:
        for d, _, names in os.walk(top):
            for name in names:
                if not name.startswith("broadcast"):
                    try:
                        total += os.path.getsize(os.path.join(d, name))
                    except OSError:  # cleaned meanwhile
                        pass
    return total


def _vectors(n, dim, seed=3):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def _frame(spark, ids, x, kind="float"):
    rows = [(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def _nearest(ids, x, q, k=5):
    x = x.astype(np.float64)
    score = ann.cosines(np.repeat(x[q:q + 1], len(x), axis=0), x)
    return [(i, s) for s, i in sorted((-s, int(i)) for s, i in zip(score, ids, strict=True) if i != ids[q])[:k]]


def test_disk_is_a_small_multiple_of_the_input(spark, tmp_path):
    n = 12_000
    path = f"{tmp_path}/embeddings.parquet"
    _frame(spark, range(n), _vectors(n, 64)).coalesce(2).write.parquet(path)
    given = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    before = _bytes(spark)
    assert ann.search(spark.read.parquet(path), F.col("vec_id") % 50 == 0).count() == 5 * n // 50
    assert _bytes(spark) - before <= 4 * given


def test_one_list_over_several_cells_is_exact(spark):
    """One list, dealt to several cells, with equal vectors, a repeated id and scores of floats."""
    ids, x = np.arange(2500), _vectors(2500, 16)
    x[1000:1900] = x[7]
    df = _frame(spark, ids, x)
    more = df.where("vec_id = 11").select("vec_id", F.transform("embedding", lambda v: v + 9).alias("embedding"))
    got = ann.search(df.unionByName(more), F.col("vec_id") % 100 == 0, size=10_000).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, -r.score))
    assert by == {q: _nearest(ids, x, q) for q in range(0, 2500, 100)}


def test_recall_beyond_the_sample(spark, monkeypatch):
    """The table is larger than the sample: vectors that had no part in the centroids fit how far a query reads."""
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    monkeypatch.setattr(ann, "ASKED", 300)
    ids, x = np.arange(6000), _vectors(6000, 24)
    got = ann.search(_frame(spark, ids, x), F.col("vec_id") % 40 == 0, size=30).collect()
    hits = 0
    for q in range(0, 6000, 40):
        hits += len({i for i, _ in _nearest(ids, x, q)} & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 750 and hits / 750 >= 0.97


def test_repeated_ids_keep_the_smallest_vector(spark, monkeypatch):
    df = _frame(spark, [1, 2, 2, 3, 3, 3], np.array([[1, 1], [5, 0], [2, 7], [4, 4], [4, 3], [4, 3]], dtype=np.float32))
    want = [(1, [1.0, 1.0]), (2, [2.0, 7.0]), (3, [4.0, 3.0])]
    for most in (ann.BROADCAST_IDS, 0):
        monkeypatch.setattr(ann, "BROADCAST_IDS", most)
        once = ann._once(df.withColumnRenamed("embedding", "vec"), 6, 3)
        assert sorted((r.vec_id, list(r.vec)) for r in once.collect()) == want


def test_first_of_equals():
    x = _vectors(40, 3)[np.random.default_rng(1).integers(0, 40, 30_000) // 4]
    ids = np.random.default_rng(2).permutation(30_000)
    got = set(ids[ann.first_of_equals(ids, x, 6)].tolist())
    groups = {}
    for i, v in sorted(zip(ids.tolist(), map(bytes, x), strict=True)):
        groups.setdefault(v, []).append(i)
    assert got == {i for g in groups.values() for i in g[:6]}
    assert ann.first_of_equals(np.arange(3), _vectors(3, 2), 1).tolist() == [0, 1, 2]


def test_cells_hold_lists_that_lie_together():
    centroids = ann.unit(_vectors(300, 8).astype(np.float64))
    sizes = np.random.default_rng(4).integers(0, 300, 300) + 0.5
    sizes[17] = 9000
    first, parts = ann.cells(centroids, sizes, 2000)
    assert parts[17] == 5 and (np.delete(parts, 17) == 1).all()
    held = {}
    for i in range(300):
        held.setdefault(first[i], []).append(i)
    assert held.pop(first[17]) == [17]
    assert max(sizes[h].sum() for h in held.values()) <= 2000 and len(held) < 1.7 * np.delete(sizes, 17).sum() / 2000
    assert not {c for c in held} & set(range(first[17], first[17] + 5))


def test_best_of_blocks():
    """Blocks in any order, ties by id, a query that is one of the vectors, fewer vectors than k."""
    x = _vectors(700, 8)
    x[300:360] = x[5] * np.float32(2)
    ids = np.random.default_rng(5).permutation(700)
    asked = np.arange(0, 700, 9)
    best = ann.Best(x[asked], 5)
    for at in (slice(0, 3), slice(3, 200), slice(600, 700), slice(200, 600)):
        best.add(np.arange(len(asked)), x[at], ids[at], lambda r, own=ann._Ids(ids[at]): own.of(ids[asked[r]]))
    for i, q in enumerate(asked):
        assert list(zip(best.key[i].tolist(), (-best.score[i]).tolist(), strict=True)) == _nearest(ids, x, q)
    few = ann.Best(x[:1], 5)
    few.add(np.arange(1), x[:3], np.arange(3), lambda r: ann._Ids(np.arange(3)).of(r))
    assert few.found(np.array([40])).column(1).to_pylist() in ([1, 2], [2, 1])


def test_a_cell_holds_what_its_queries_read():
    """Vectors of two cells and their queries in one stream of small batches."""
    import pyarrow as pa

    x = _vectors(60, 4)
    graph = ann.Graph(ann.unit(_vectors(2, 4, 9).astype(np.float64)).astype(np.float32), np.array([0, 1]), np.array([1, 1]))
    rows = [(c, c, i, x[i].tolist(), 0.0) for c in (0, 1) for i in range(c, 60, 2)]
    rows += [(c, ann.QUERY, 100 + i, x[i].tolist(), np.inf) for c in (0, 1) for i in (3, 4)]
    rows.sort(key=lambda r: r[:2])
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + 7], strict=True), types, strict=True)],
                                          ["cell", "list", "vec_id", "vec", "limit"]) for lo in range(0, len(rows), 7)]
    found = ann._search(iter(batches), SimpleNamespace(value=graph), 2)
    got = sorted(r for b in found for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    want = []
    for q in (3, 4):
        for c in (0, 1):
            ids = np.append(np.arange(c, 60, 2), 100 + q)
            want += [(100 + q, i, -s) for i, s in _nearest(ids, x[np.append(np.arange(c, 60, 2), q)], 30, 2)]
    assert got == sorted(want)
