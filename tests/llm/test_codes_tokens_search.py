"""Operators 11 to 13: exact products, file format, bounds and rescoring; whole tables and edge cases against brute force."""

import hashlib
import math
import re
import zlib
from fractions import Fraction
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retainr.llm import lexical, tokenfiles, vectorcodes
from retainr.llm.queries import QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.conftest import EDGES, read

WORDS = public_tokenizers.path("word_bpe_49k.json")
OTHER = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- vector codes

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0, 5, 19, 20, 21, 27]), st.integers(1, 9))
def test_limb_products_are_exact(seed, bits, width):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(-(1 << bits), (1 << bits) + 1, (n, width)) for n in (4, 3))
    want = [[sum(a * b for a, b in zip(r, c, strict=True)) for c in y.tolist()] for r in x.tolist()]
    assert vectorcodes.exact_products(x, y).tolist() == want


def test_limb_products_over_many_positions():
    x = np.full((1, 3 * vectorcodes.SLICE + 1), (1 << 24) - 1)
    assert vectorcodes.exact_products(x, -x)[0, 0] == -x.shape[1] * ((1 << 24) - 1) ** 2


def plain_codes(rows, entries=16, rounds=6, parts=8):
    """rows: (vec_id, vector of floats, label); the contract in plain integers."""
    kept = [(i, [math.floor(4096 * Fraction(x)) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], book)[1], []).append(c[p])
            for e, g in groups.items():
                book[e] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=str)


def test_vector_codes_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, SF_SMALL).collect()), key=str)
    assert got == plain_codes(read(SF_SMALL, "vec_id, embedding, label", "embeddings"))


def test_vector_codes_edges(spark):
    rng = np.random.default_rng(1)
    fine = [(i, rng.normal(0, 40, 16).tolist(), "a" if i % 3 else None) for i in range(60)]
    fine += [(7, fine[7][1], "b"), (None, fine[3][1], "a"), (99, [30_000.0, -30_000.0] * 8, "b"), (98, [-0.0] * 16, None),
             (97, [30_000.0, -30_000.0] * 8, "b")]
    bad = [(200, None, "a"), (201, [1.0] * 15 + [None], "a"), (202, [1.0] * 15 + [float("nan")], "a"),
           (203, [float("inf")] * 16, "a"), (204, [1.0] * 8, "a"), (205, [], "a"), (206, [1.0] * 15, "b"), (207, [1e30] * 16, "b")]
    df = spark.createDataFrame(fine + bad, "vec_id long, embedding array<double>, label string").withColumns(
        {c: F.lit(c) for c in ("x", "of", "code", "error", "part", "n")})
    assert sorted((tuple(r) for r in vectorcodes.compress(df).collect()), key=str) == plain_codes(fine)
    few = df.where("vec_id < 5")  # fewer rows than entries
    assert sorted((tuple(r) for r in vectorcodes.compress(few).collect()), key=str) == plain_codes(fine[:5])
    assert vectorcodes.compress(df.limit(0)).count() == 0
    assert vectorcodes.compress(df.where("vec_id = 200")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 1)
    got = sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, SF_SMALL).collect()), key=str)
    assert got == plain_codes(read(SF_SMALL, "vec_id, embedding, label", "embeddings"))


# ---------------------------------------------------------------- token files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_pack_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    control, data = tokenfiles.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert len(data) == sum(max(1, -(-x.bit_length() // 8)) for x in values)
    assert tokenfiles.unpack(control, data, len(v)).tolist() == values


def plain_tokens(docs, path=WORDS):
    """{row: ...} in order of id: the whole texts through the tokenizer, one by one."""
    t = Tokenizer.from_file(path)
    out, start = [], 0
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_whole_table(spark):
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, SF_ORACLE).collect())
    assert got == plain_tokens(sorted(read(SF_ORACLE, "doc_id, text")))


@cache
def _word_encoder():
    with open(WORDS, encoding="utf-8") as f:
        return tokenfiles.Encoder(f.read()), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x85\xa0 'sSİıΣςȩ́é가각ᄀ漢<|endoftext|>12a,"), st.characters(
    codec="utf-8")), max_size=40)))
def test_words_apart_equal_whole_texts(texts):
    import pyarrow as pa

    (encoder, t), got = _word_encoder(), []
    assert encoder.by_word
    texts = [*texts, None, "they're <|endoftext|>x<|startoftext|> don't", " ".join(texts)]
    for _, ids, offsets in encoder.encode(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path", [WORDS, OTHER])
def test_token_files_edges(spark, edges, no_rows, path):
    rows = [(i, t) for i, t, _, _ in EDGES] + [(None, "null id"), (None, ""), (-5, "early <|endoftext|> \x00 text")]
    df = edges.select("doc_id", "text", "ord", F.lit(1).alias("shard"), F.lit(1).alias("ids"), F.lit(1).alias("n")).unionByName(
        spark.createDataFrame(rows[-3:], "doc_id long, text string").withColumns(
            {"ord": F.lit(""), "shard": F.lit(1), "ids": F.lit(1), "n": F.lit(1)}))
    files = tokenfiles.write(df, path, shard_bytes=40_000)
    got = files.digests().collect()
    t = Tokenizer.from_file(path)
    ids = {(i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,)) for i, x in rows}
    back = files.documents().orderBy("shard", "at").collect()
    assert len({r.shard for r in back}) > 1
    assert [r.doc_id for r in back] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert {(r.doc_id, tuple(r.ids)) for r in back} == ids and len(back) == len(rows)
    start, want = 0, []
    for r in back:
        want.append((r.doc_id, start, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())))
        start += len(r.ids)
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert tokenfiles.write(no_rows, path).digests().count() == 0


def test_ranks_are_by_frequency(spark):
    df = spark.createDataFrame([(i, "the the the of of cat") for i in range(9)], "doc_id long, text string")
    files = tokenfiles.write(df, WORDS)
    ranks = spark.read.parquet(f"{files.path}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == [27, 18, 9, 9] and ranks[2].id == 1


def test_hot_null_ids_are_split(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    files = tokenfiles.write(df, WORDS, shard_bytes=1000)
    per = [r["count"] for r in files.documents().groupBy("shard").count().collect()]
    assert sum(per) == 6000 and max(per) < 1200


# ---------------------------------------------------------------- lexical search

def plain_search(docs, items, k=20):
    def terms(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    counts = [{w: b.count(w) for w in set(b)} if len(b) < 1000 else _count(b) for _, b in bags]
    df = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (i, b), c in zip(bags, counts, strict=True):
            m = 75 + 25 * len(b) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                    for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return out


def _count(b):
    out = {}
    for w in b:
        out[w] = out.get(w, 0) + 1
    return out


def test_search_edges(spark, edges, no_rows):
    rows = [(i, t) for i, t, _, _ in EDGES] + [(None, "one shared1 a"), (None, "..."), (20, "One " * 400), (21, "one\x00two-ONE é1É")]
    items = [(1, "one A é1É shared1 shared1 word5x1"), (2, None), (3, "?!"), (4, "nowhere"), (5, "one"), (5, "one"), (None, "漢字 café")]
    docs = edges.select("doc_id", "text", "score", "rank", F.lit(0).alias("n"), F.lit("").alias("terms")).unionByName(
        spark.createDataFrame(rows[-4:], "doc_id long, text string").withColumns(
            {"score": F.lit(""), "rank": F.lit(""), "n": F.lit(0), "terms": F.lit("")}))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit(3)).withColumn("doc_id", F.lit(1))
    index = lexical.build(docs)
    want = sorted(plain_search(rows, items), key=str)
    for block_terms in (lexical.BLOCK_TERMS, 1):
        assert sorted((tuple(r) for r in lexical.search(index, asked, block_terms=block_terms).collect()), key=str) == want
    assert lexical.search(index, asked.limit(0)).count() == 0
    assert lexical.search(lexical.build(no_rows), asked).count() == 0


def test_bounds_hold_and_prune(spark):
    """No bound is below its score, and most documents are not rescored."""
    import pyarrow as pa

    docs = [(i, t) for i, t in read(SF_ORACLE, "doc_id, text") if t]
    items = read(SF_ORACLE, "item_id, text", "benchmark")
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    parts = list(lexical._index([batch]))
    n_docs, n_terms = sum(p.num_rows for p in parts), sum(sum(p.column(1).to_pylist()) for p in parts)
    hashes = []
    for i, t in items:
        hashes += [(i, lexical.term_hashes(b)) for b in lexical.term_blocks(pa.array([t]))]
    block = lexical.Items.of(hashes)
    df = np.zeros(len(block.vocabulary), dtype=np.int64)
    for r in lexical._holders([p.select(["terms"]) for p in parts], type("B", (), {"value": block.vocabulary})):
        df[np.asarray(r.column(0))] = np.asarray(r.column(1))
    weights = np.array([lexical.weight(n_docs, n) if n else 0 for n in df.tolist()])
    for p in parts:
        for group in lexical._batches_by_size(p, n_docs, n_terms, len(items)):
            bounds = group.bounds(block, weights)
            for i in range(len(items)):
                w = weights[block.terms[i]] * block.repeats[i]
                assert (group.scores(np.arange(len(group.ids)), block.vocabulary[block.terms[i]], w) <= bounds[i]).all()

    class Counter:
        n = 0

        def add(self, x):
            self.n += x

    seen = Counter()
    list(lexical._best_documents(parts, block, weights, n_docs, n_terms, 20, seen))
    print("rescored", seen.n, "of", n_docs * len(items))
    assert seen.n < 0.6 * n_docs * len(items)
