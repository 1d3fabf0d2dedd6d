"""Every registered query of the package over whole tables, against SQL or brute force."""

import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from retainr.checks.compare import compare, duckdb_connect
from retainr.llm.queries import QUERIES, SQL
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import read


def test_all_operators_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert [x for x in names if x.startswith(f"op{n}_")], n
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    ok, message = compare(QUERIES[name](spark, SF_ORACLE).toPandas(), duckdb_connect(SF_ORACLE).sql(SQL[name]).df())
    assert ok, message


def test_substrings_brute_force(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF_ORACLE).collect()}
    assert got == brute.substrings(documents)


def test_pseudo_likelihood(spark, documents):
    g = QUERIES["op2_pseudo_likelihood"](spark, SF_ORACLE).toPandas()
    assert sorted(g.doc_id) == sorted(documents)
    assert dict(zip(g.doc_id, g.n_tokens)) == {i: len(brute.words(t)) for i, t in documents.items()}
    assert (g.log_likelihood < 0).all() and np.allclose(g.mean_log_likelihood * g.n_tokens, g.log_likelihood)
    # both sides tell more than the frequencies of the words alone
    from collections import Counter

    counts = Counter(w for t in documents.values() for w in brute.words(t.translate(brute.LOWER)))
    n = sum(counts.values())
    assert g.log_likelihood.sum() / n > sum(c * np.log(c / n) for c in counts.values()) / n + 0.1


def test_leaks(spark, documents):
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op3_decontaminate"](spark, SF_ORACLE).collect()}
    assert got == brute.leaks(documents, read(SF_ORACLE, "item_id, text", "benchmark"))


def test_language_held_out(spark):
    lang = dict(read(SF_ORACLE, "doc_id, lang"))
    rows = QUERIES["op4_language"](spark, SF_ORACLE).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_pii(spark, documents):
    import hashlib

    for r in QUERIES["op5_pii"](spark, SF_ORACLE).collect():
        counts, spans = brute.pii(documents[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = QUERIES["op6_nearest_neighbours"](spark, sf).toPandas()
    hits = 0
    asked = np.flatnonzero(ids % 50 == 0)
    assert len(got) == 5 * len(asked)
    for q in asked:
        s = x @ x[q]
        s[q] = -9
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:5]]))
    assert hits / (5 * len(asked)) >= 0.9


def test_toxicity_held_out(spark):
    toxic = dict(read(SF_ORACLE, "doc_id, toxic", "labels"))
    rows = QUERIES["op7_toxicity"](spark, SF_ORACLE).collect()
    assert len(rows) == len(dict(read(SF_ORACLE, "doc_id, lang")))
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([b for a, b in held if a]) > 0.6 and np.mean([b for a, b in held if not a]) < 0.05


def test_near_duplicates_brute_force(spark):
    docs = dict(read(SF_SMALL, "doc_id, text"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_near_duplicates"](spark, SF_SMALL).collect()}
    assert got == brute.near(docs)


def test_mix(spark):
    docs = {i: (len(brute.words(t)), s) for i, t, s in read(SF_ORACLE, "doc_id, text, source")}
    rows = QUERIES["op10_mix_sources"](spark, SF_ORACLE).collect()
    sizes, taken, largest = {}, {}, {}
    for n, s in docs.values():
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    target = brute.targets(sizes)
    for r in rows:
        n, s = docs[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[s]) and r.taken <= 2 * n
        assert abs(r.target - target[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], s
    again = QUERIES["op10_mix_sources"](spark, SF_ORACLE).collect()
    assert sorted(rows) == sorted(again)
