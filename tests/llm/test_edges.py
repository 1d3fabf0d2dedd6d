"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainr.llm import ann, chat, decontam, langid, mixing, neardup, pii, pseudolikelihood, substrings, toxicity
from tests.llm import brute
from tests.llm.conftest import EDGES, PASSAGE

TEXTS = {i: t for i, t, _, _ in EDGES}


def test_substrings(edges, no_rows):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(edges).collect()]
    want = brute.substrings(TEXTS)
    assert len(got) == len(EDGES)
    assert {g[0]: g[1:] for g in got} == want
    assert substrings.dedup_substrings(no_rows).count() == 0


def test_substrings_null_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE), (None, PASSAGE), (3, PASSAGE)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substrings.dedup_substrings(df).collect())
    assert got == [(-1, 60), (-1, 60), (3, 0)]  # ids that are null come after 3, and do not shadow each other


def test_pseudo_likelihood(edges, no_rows):
    model = pseudolikelihood.train(edges)
    rows = pseudolikelihood.score(edges, model, ["doc_id", "score"]).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.n_tokens == len(brute.words(TEXTS[r.doc_id]))
        assert (r.log_likelihood < 0) == (r.n_tokens > 0)
    assert pseudolikelihood.score(no_rows, pseudolikelihood.train(no_rows), ["doc_id"]).count() == 0


def test_pseudo_likelihood_is_a_distribution(edges):
    model = pseudolikelihood.train(edges)
    assert np.allclose(np.exp(model.log_class).sum(axis=-1), 1)
    assert np.allclose(np.exp(model.log_word.astype(float)).sum(axis=-1), 1, atol=1e-3)


def test_decontam(spark, edges, no_rows):
    items = [(1, PASSAGE[:400]), (2, None), (3, ""), (4, "one"), (5, "shared1 shared2 CHANGED, shared4 shared5 shared6 shared7"),
             (5, "shared1 shared2 CHANGED, shared4 shared5 shared6 shared7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(edges, bench).collect()
    want = brute.leaks(TEXTS, [(i, t) for i, t in items])
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want
    kept = decontam.decontaminate(edges, bench)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in EDGES if i not in {d for d, _ in want})
    assert decontam.leaks(edges, bench.limit(0)).count() == 0
    assert decontam.leaks(no_rows, bench).count() == 0


def test_myers_against_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p, t = rng.integers(0, 4, rng.integers(1, 70)).tolist(), rng.integers(0, 4, rng.integers(0, 60)).tolist()
        masks = {}
        for j, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << j
        assert decontam.myers(masks, len(p), t)[0] == brute.best_distance(p, t)


def test_language(edges, no_rows):
    model = langid.train(edges)
    rows = langid.identify(edges, model, ["doc_id", "rank"]).collect()
    assert len(rows) == len(EDGES)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "fr", "es", "und") and 0 <= r.score <= 1 for r in rows)
    none = langid.identify(edges, langid.train(no_rows), ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}


HARD = [
    "a@b.c_d@e.f x@y z@w.v..u a@@b.c -@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 1..2.3.4 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 12 3 4",
    "+49 (0)30 1234567 +1-2 ++33 1 23 45 67 89 +123456789012345678 +1 )(.",
    "é漢\U0001f600 me@example.org \U0001f600 10.0.0.1", "5" * 5000, "a" * 100_000, "1." * 50_000, "a@" + "b." * 30_000 + "c",
    "+1" + " " * 50_000, None, "",
]


def test_pii_hard_texts(spark, no_rows):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("pii_x", F.lit(1))
    for r in pii.span_columns(df).collect():
        counts, spans = brute.pii(HARD[r.doc_id])
        mine = [f"{s.kind}:{s.start}:{s.end}" for k in pii.BASE for s in r[f"pii_{k}"]]
        assert ",".join(mine) == spans, (r.doc_id, mine, spans)
    assert pii.span_columns(no_rows).count() == 0


def test_pii_iban_context_and_redaction(spark):
    texts = ["my iban GB82 WEST 1234 5698 7654 32.", "code GB82 WEST 1234 5698 7654 33.", "mail: a@b.org, ip 1.2.3.4!", None, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.span_columns(df).collect()}
    assert [(s.start, s.end) for s in rows[0].pii_iban] == [(8, 35)] and not rows[1].pii_iban
    assert rows[0].pii_iban[0].score == pytest.approx(0.9) and rows[2].pii_email[0].score == pytest.approx(1.0)
    done = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert done == {0: "my iban [IBAN].", 1: texts[1], 2: "mail: [EMAIL], ip [IP]!", 3: None, 4: "plain"}


def test_neighbours(spark):
    same = [0.5, 0.25, 1.0]
    rows = [(i, same) for i in range(0, 400)] + [(400, None), (450, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]),
                                                 (550, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]),
                                                 (650, [1.0, 2.0]), (700, [-1.0, 0.0, 0.5]), (700, [-1.0, 0.0, 0.5]), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(by) == [0, 50, 100, 150, 200, 250, 300, 350, 700]
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4] and len(by[700]) == 5
    few = df.where("vec_id IN (0, 1, 700)")
    assert {(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") % 50 == 0).collect()} == {
        (0, 1, 1), (0, 2, 700), (700, 1, 0), (700, 2, 1)}
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_levenshtein_trie():
    terms = ["idiot", "scum", "worthless", "lowei"]
    trie = toxicity.Trie(terms)
    for word in ["idiot", "idiots", "idoit", "idot", "xidiot", "scum", "scun", "worthles", "wortless", "lowe", "loweisp", "l0weisp",
                 "clowei", "", "w", "idiiot"]:
        near = sorted((d, t) for t in terms if (d := brute.near_prefix(t, word)) <= (1 if len(t) >= 5 else 0))
        assert (trie.match(word) is not None) == bool(near), word
        if near:
            assert trie.match(word)[1] == near[0][0], word


def test_toxicity(spark, edges, no_rows):
    rows = [(i, f"alpha beta{i} you moron{'' if i % 3 else 's'} gamma{i} delta") for i in range(40)]
    rows += [(100 + i, f"alpha beta{i} nice gamma{i} delta") for i in range(80)]
    docs = spark.createDataFrame(rows + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.terms == ["moron"]
    probe = spark.createDataFrame([(1, "what a moron is that"), (2, "what a m0ron is that"), (3, 'he said "moron" to quote it'),
                                   (4, "a calm text"), (5, None), (6, "")], "doc_id long, text string").withColumn("toxicity", F.lit(1))
    got = {r.doc_id: r.p for r in toxicity.score(probe, model, ["doc_id", "toxicity"], out="p").collect()}
    assert got[1] > 0.5 and got[4] == got[5] == got[6] < 0.3 and got[3] < got[1]
    assert len(toxicity.score(edges, model, edges.columns, out="__p").collect()) == len(EDGES)
    nothing = toxicity.score(edges, toxicity.train(docs, labels.limit(0)), ["doc_id"]).collect()
    assert {r.toxicity for r in nothing} == {0.0}
    assert toxicity.score(no_rows, model, ["doc_id"]).count() == 0


def test_near_duplicates(edges, no_rows, spark):
    got = neardup.near_duplicates(edges).collect()
    want = brute.near(TEXTS)
    assert len(got) == len(EDGES)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(no_rows).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(null).collect()) == [
        (-1, -1, True), (-1, -1, True), (2, 2, True)]


def test_near_duplicate_chain(spark):
    """Links of different texts are found through several buckets and closed into one component."""
    base = [f"w{i}" for i in range(120)]
    docs, w = {}, list(base)
    for i in range(12):
        docs[i] = " ".join(w)
        w[i * 10] = f"new{i}"
    docs[50] = " ".join(base[:60] + [f"z{i}" for i in range(60)])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == brute.near(docs)


def test_components(spark):
    from retainr.llm.components import components

    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)] + [(500, i) for i in range(501, 540)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(1, 61)} == {1} and {got[100], got[200], got[300]} == {100}
    assert {got[i] for i in range(500, 540)} == {500}


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|im_end|>\n<|b"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "only <"), (3, 5, "user", "no answer \\"), (3, 5, "user", "no answer \\"), (4, None, None, None),
    (None, 0, "sys\ntem\\n", "x"), (None, 1, "assistant", "é漢\U0001f600 \\| <\\|"),
]


def test_chat(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    by = {}
    for c, t, r, x in sorted(CONVERSATIONS, key=lambda v: (v[0] or -1, v[1] if v[1] is not None else -1)):
        by.setdefault(c, []).append((r or "", x or ""))
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    rows = [r for r in examples.collect() if r.conv_id == 1]
    assert [r.loss_start >= 0 for r in sorted(rows, key=lambda r: r.example)] == [True, True]
    first = min(rows, key=lambda r: r.example)
    assert chat.turns_of(first.text) == by[1][:2]  # the context ends with the target
    assert chat.expand(df.limit(0)).count() == 0


def test_escape_round_trip():
    rng = np.random.default_rng(2)
    for _ in range(500):
        s = "".join(rng.choice(list("<|\\ana>\n"), rng.integers(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


def test_mix(edges, no_rows):
    rows = mixing.mix(edges).collect()
    sizes = {}
    for i, t, _, s in EDGES:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    target = brute.targets(sizes)
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.mix_size == len(brute.words(TEXTS[r.doc_id])) and abs(r.mix_target - target[r.source]) < 1e-6
        assert 0 <= r.mix_copies <= 2 and r.target == "target"
    out = mixing.repeated(mixing.mix(edges))
    assert out.count() == sum(r.mix_copies for r in rows)
    assert mixing.mix(no_rows).count() == 0


def test_decontam_reports_the_best_place(spark):
    """An item that occurs twice in a document, first changed and then unchanged, and the other way round."""
    item = " ".join(f"w{i}" for i in range(20))
    changed = item.replace("w4 ", "x4 ").replace("w15", "x15")
    filler = " ".join(f"f{i}" for i in range(30))
    texts = [f"{changed} {filler} {item}", f"{item} {filler} {changed}", f"{changed} {item}", f"{filler} {changed} {changed}",
             f"{item} {item}", item.replace("w4 ", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.edits, r.first_word, r.end_word) for r in decontam.leaks(df, bench).collect()}
    assert got == {0: (0, 50, 70), 1: (0, 0, 20), 2: (0, 20, 40), 3: (2, 30, 50), 4: (0, 0, 20), 5: (1, 0, 19)}
    assert {(i, 1): e for i, (e, _, _) in got.items()} == brute.leaks(dict(enumerate(texts)), [(1, item)])


@pytest.mark.parametrize("kind", ["no structure", "clusters"])
def test_neighbours_recall_with_many_lists(spark, kind):
    """More than 1,000 lists: the distance ratio alone selects those that a query reads."""
    rng = np.random.default_rng(11)
    n, dim = 16_000, 32
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = rng.normal(size=(400, dim))[rng.integers(0, 400, n)] + 0.35 * x
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = 320
    lists = {}
    real = ann.build

    def watched(*args):
        lists["graph"] = real(*args)
        return lists["graph"]

    ann.build, got = watched, None
    try:
        got = ann.search(df, F.col("vec_id") % (n // asked) == 0, size=14).toPandas()
    finally:
        ann.build = real
    assert len(lists["graph"].centroids) > 1000
    u = ann.unit(x)
    hits = 0
    for q in range(0, n, n // asked):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-s, kind="stable")[:5].tolist()))
    read = np.mean([len(lists["graph"].near(u[q:q + 1].astype(np.float32), lists["graph"].reach)[1]) for q in range(0, n, 500)])
    print(kind, "recall", hits / (5 * asked), "lists read", read, "of", len(lists["graph"].centroids))
    assert hits / (5 * asked) >= 0.9
