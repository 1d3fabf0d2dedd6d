"""Every stage of the corpus pipeline against a plain Python version, on given documents and on hard rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retainr.llm import toxicity
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import EDGES, LONG, PASSAGE, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PROSE = " ".join(f"plain{i} line{i % 17}" for i in range(40))
HARD = [
    (901, PROSE, "en", "a", None), (901, PROSE, "en", "a", 5), (902, PROSE, "en", None, 5), (None, PROSE, "en", "a", 5),
    (None, PASSAGE + " one", "en", "b", 1), (None, PASSAGE + " one", "en", "b", 1), (None, None, None, None, None),
    (None, "", "en", "a", 0), (903, "mail me@example.org or 10.1.2.3, card 4111 1111 1111 1111.", "en", "b", 60),
    (904, "call +49 30 1234567 now; iban GB82 WEST 1234 5698 7654 32", "en", "b", 60),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables: the small documents, the edge table and the rows above."""
    path = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = [(800 + i, t, lang, s, len(t or "")) for i, t, lang, s in EDGES] + HARD
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").unionByName(spark.createDataFrame(more, schema)).write.parquet(
        f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, tables):
    """The rows after each stage; every stage gets what the one before kept."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, tables), name)
        assert docs.columns[:5] == COLUMNS
        out[name] = docs.collect()
    return out


def _rows(rows):
    return Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------- toxicity

def _plain_toxicity(text, terms, weights):
    low = (text or "").lower()
    # words with their places; ASCII punctuation separates
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)]
    found, seen = [0, 0, 0], set()
    for k, (s, e) in enumerate(words):
        best = min(((d, t) for t in terms for d in [brute.near_prefix(t, low[s:e])]
                    if d == 0 or d <= toxicity.EDITS and len(t) >= toxicity.FUZZY_FROM), default=None)
        if best is None:
            continue
        near = words[max(0, k - toxicity.WINDOW):k + toxicity.WINDOW + 1]
        first, last = near[0][0], near[-1][1]
        before = any(c in "\"'`" for c in low[max(first - 1, 0):s])
        after = any(c in "\"'`" for c in low[e:last + 1])
        quoted = before and after or any(low[a:b] in toxicity.REPORTING for a, b in near)
        found[2 if quoted else 1 if best[0] else 0] += 1
        seen.add(best[1])
    x = [math.log1p(found[0]), math.log1p(found[1]), math.log1p(found[2]), math.log1p(len(seen)),
         sum(found) / max(1, len(words)) if seen else 0.0, 1.0]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, weights))))))


def test_toxicity_scores_are_the_plain_ones(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert model.terms
    short = docs.where("length(text) < 3000 OR text IS NULL")
    for r in toxicity.score(short, model, ["text"]).collect():
        assert r.toxicity == pytest.approx(_plain_toxicity(r.text, model.terms, model.weights), abs=1e-9), (r.text or "")[:80]


def test_toxic_documents_go(spark, tables, stages):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    scored = toxicity.score(docs, model, COLUMNS).collect()
    assert _rows(stages["toxicity"]) == _rows(tuple(r)[:5] for r in scored if r.toxicity < toxicity.THRESHOLD)
    toxic = dict(read(SF_SMALL, "doc_id, toxic", "labels"))
    left = {r.doc_id for r in stages["toxicity"]}
    assert np.mean([i in left for i, t in toxic.items() if t == 0]) > 0.97
    assert len(stages["toxicity"]) < len(stages["documents"])


# ---------------------------------------------------------------- near duplicates

def test_one_row_of_each_group_stays(stages):
    rows = stages["toxicity"]
    group = brute.near({i: r.text for i, r in enumerate(rows)}, corpus_pipeline.SIMILARITY)
    best = {}
    for i, r in enumerate(rows):
        key = (r.doc_id is None, r.doc_id or 0)
        g = group[i][1]
        best[g] = min(best.get(g, (key, i)), (key, i))
    got = stages["near_duplicates"]
    # rows that share id and group may differ in other columns: which of them stays is open
    assert Counter((r.doc_id, r.text) for r in got) == Counter((rows[i].doc_id, rows[i].text) for _, i in best.values())
    assert not _rows(got) - _rows(rows)
    texts = Counter(r.text for r in got if r.text and r.text.split())
    assert max(texts.values()) == 1
    assert sum(r.text == PROSE for r in got) == 1 and sum((r.text or "").startswith(LONG[:50]) for r in got) == 1


# ---------------------------------------------------------------- decontamination

def test_contaminated_documents_go(stages):
    rows = stages["near_duplicates"]
    items = read(SF_SMALL, "item_id, text", "benchmark")
    leaked = {i for i, _ in brute.leaks({i: r.text for i, r in enumerate(rows) if len(r.text or "") < 100_000}, items)}
    assert leaked
    assert _rows(stages["decontaminate"]) == _rows(r for i, r in enumerate(rows) if i not in leaked)


# ---------------------------------------------------------------- personal data

IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"


def _plain_redaction(text):
    if not text:
        return text
    spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in brute.pii(text)[1].split(",") if s)]
    for m in re.finditer(IBAN, text):
        n = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1:
            spans.append((m.start(), m.end(), "iban"))
    out, at = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_personal_data_is_replaced(stages):
    rows = stages["decontaminate"]
    want = Counter()
    for r in rows:
        t = _plain_redaction(r.text)
        want[(r.doc_id, t, r.lang, r.source, len(t) if t is not None else r.n_chars)] += 1
    assert _rows(stages["redact_pii"]) == want
    assert any("[EMAIL]" in (r.text or "") for r in stages["redact_pii"])


# ---------------------------------------------------------------- mixing

def _md5(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)


def _plain_mix(rows):
    """(doc_id, text) -> copies, by the definition: one running number a source, one offset."""
    sizes, by_source = {}, {}
    for r in rows:
        n = len(brute.words(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        i = "null" if r.doc_id is None else str(r.doc_id)
        bits = bin(n + 4)[2:]
        h = _md5("mix-1", i)
        key = (4 * len(bits) + int(bits[1:3], 2), h % 1024, n, h, (r.doc_id is not None, i))
        by_source.setdefault(r.source, []).append((key, r))
    target, out = brute.targets(sizes), Counter()
    for source, docs in by_source.items():
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        u = _md5("mix-1", source if source is not None else "null") / 2**32
        for i, (_, r) in enumerate(sorted(docs, key=lambda x: x[0])):
            for copy in range(min(2, math.floor(u + (i + 1) * rate) - math.floor(u + i * rate))):
                out[(r.doc_id, r.text, r.source, copy)] += 1
    return out


def test_mix_takes_what_the_definition_takes(stages):
    got = Counter((r.doc_id, r.text, r.source, r["copy"]) for r in stages["mix_sources"])
    assert got == _plain_mix(stages["redact_pii"])


def test_run_is_the_stages(spark, tables, stages):
    assert _rows(corpus_pipeline.run(spark, tables).collect()) == _rows(stages["mix_sources"])


def test_pipeline_without_rows(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
