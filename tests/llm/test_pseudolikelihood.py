"""The scorer against a plain version of its formula, and what it must tell apart."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainr.llm import blocks as B
from retainr.llm import pseudolikelihood as P
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import read

SUBJECTS, VERBS, OBJECTS = (
    "the farmer,my uncle,a neighbour,the old teacher,her sister".split(","),
    "carried slowly,bought cheaply,painted again,looked after,finally sold".split(","),
    "the wooden cart,a heavy basket,some green apples,the broken fence,his only horse".split(","))


def prose(rng, sentences=12):
    return " ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} ." for _ in range(sentences))


def mixed(rng, text):
    words = text.split()
    rng.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def scored(spark):
    """(texts, model, {doc_id: row}): 200 of prose, 20 of these shuffled, 20 of words that occur once."""
    rng = random.Random(5)
    texts = [prose(rng) for _ in range(200)]
    texts += [mixed(rng, t) for t in texts[:20]]
    texts += [" ".join(f"q{rng.randrange(10**12)}{x}" for x in "aeioubcd" * 12) for _ in range(20)] + ["", None, "lone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = P.train(docs)
    return texts, model, {r.doc_id: r for r in P.score(docs, model, ["doc_id"]).collect()}


def test_words_and_pairs_are_counted_by_full_hash(scored):
    texts, model, _ = scored
    words = [brute.words((t or "").translate(brute.LOWER)) for t in texts]
    rows = model.counts.collect()
    assert len({r.key for r in rows}) == len(rows)
    assert sorted(r.n for r in rows if r.kind == 0) == sorted(Counter(x for w in words for x in w).values())
    pairs = Counter(p for w in words for p in zip(w, w[1:]))
    assert sorted(r.n for r in rows if r.kind == 1) == sorted(n for n in pairs.values() if n > 1)


def test_the_vocabulary_is_not_folded_into_slots(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(9999)), lambda i: F.concat(F.lit("w"), F.col("id") * 10000 + i, F.lit("x")))).alias("text"))
    assert P._count_words(docs.select("text")).count() == 200_000


def test_formula(scored):
    texts, model, rows = scored
    words = [brute.words((t or "").translate(brute.LOWER)) for t in texts]
    n, pairs = Counter(x for w in words for x in w), Counter(p for w in words for p in zip(w, w[1:]))

    def class_of(word):
        data = np.frombuffer(word.encode(), np.uint8)
        block = B._block(0, data.copy(), np.array([0, len(data)]))
        return int(model.classes(*P._tokens(block))[0])

    of = {w: class_of(w) for w in n}
    in_class, distinct = Counter(), Counter(of.values())
    for w, k in n.items():
        in_class[of[w]] += k
    for i, w in enumerate(words):
        total, c = 0.0, [of[x] for x in w]
        for j, x in enumerate(w):
            at = lambda k: c[k] if 0 <= k < len(c) else 0
            q = sum(s * np.exp(model.log_class[d - 1, at(j - d), at(j + d), c[j]]) for d, s in ((1, 1 - P.OUTER), (2, P.OUTER)))
            if c[j] > P.TOP:
                q *= (n[x] - 1 + model.smooth) / (in_class[c[j]] - 1 + model.smooth * (distinct[c[j]] + 1))
            left = (pairs[w[j - 1], x] - 1 + P.MU * q) / (n[w[j - 1]] - 1 + P.MU) if j else q
            right = (pairs[x, w[j + 1]] - 1 + P.MU * q) / (n[w[j + 1]] - 1 + P.MU) if j + 1 < len(w) else q
            total += np.log((left + right) / 2)
        assert rows[i].n_tokens == len(w) and rows[i].log_likelihood == pytest.approx(total, rel=1e-5)


def test_shuffled_and_rare_texts_score_lower(scored):
    _, _, rows = scored
    mean = [rows[i].mean_log_likelihood for i in range(240)]
    assert all(mean[200 + i] < mean[i] - 0.5 for i in range(20))
    assert max(mean[220:240]) < min(mean[:220])


def test_texts_outside_the_corpus(spark, scored):
    _, model, rows = scored
    rng = random.Random(6)
    fresh = prose(rng)
    docs = spark.createDataFrame([(1, fresh), (2, mixed(rng, fresh)), (3, "zzyx qwrt pfgh zzyx"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in P.score(docs, model, ["doc_id"]).collect()}
    assert got[1] > got[2] + 0.5 and got[2] > got[3] and got[4] == 0


def test_order_tells_on_the_given_documents(spark):
    """Words of a class shared by many: shuffling the whole document must cost likelihood."""
    rng, texts = random.Random(3), dict(read(SF_SMALL, "doc_id, text"))
    docs, shuffled = (spark.createDataFrame(list(x.items()), "doc_id long, text string")
                      for x in (texts, {i: mixed(rng, t or "") for i, t in texts.items()}))
    model = P.train(docs)
    a, b = (P.score(d, model, ["doc_id"]).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first() for d in (docs, shuffled))
    assert a[1] == b[1] and a[0] / a[1] > b[0] / b[1] + 0.5
