"""What a worker holds besides its Arrow batch is bounded by a block, not by the batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from retainr.llm import blocks as B
from retainr.llm import decontam, neardup, tokenfiles, toxicity
from retainr.llm.shared import arrow_batches
from tests.llm.test_codes_tokens_search import WORDS

ITEM = " ".join(f"item{i}" for i in range(20))
N = 6000
SLACK = 1 << 21  # of a batch that a worker hands out
_POOLS = []  # an encoder's pieces outlive the run that made them


def _texts():
    rng = np.random.default_rng(7)
    words = np.array([f"Word{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 600)]) for _ in range(N)]
    texts[10], texts[11] = None, ""
    texts[N // 2] += " " + ITEM + " tail"
    texts[-1] = ITEM
    return texts


def _peak(run, batch):
    """Largest bytes held at once beyond the batch, by Arrow and numpy, and the batches handed out."""
    default = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(default)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        sizes, rows = [], []
        for out in run(iter([batch])):
            sizes.append(sum(len(x) if x is not None else 0 for x in (out.column(1).to_pylist())))
            rows += out.column(0).to_pylist()
            del out
        return pool.max_memory() + tracemalloc.get_traced_memory()[1], sizes, rows
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(default)


def test_decontaminate_holds_a_block(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array(_texts())], ["doc_id", "text"])
    index = decontam.Index([(1, ITEM)])
    monkeypatch.setattr(decontam, "_item_blocks", lambda *_: [index])
    runs = []
    docs = SimpleNamespace(
        columns=["doc_id", "text"], schema="doc_id long, text string", mapInArrow=lambda run, _: runs.append(run),
        sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    decontam.decontaminate(docs, None)
    list(runs[0](iter([batch.slice(0, 2000)])))  # tables of powers are made once
    held, sizes, rows = _peak(runs[0], batch)
    assert rows == [i for i in range(N) if i not in (N // 2, N - 1)]
    assert max(sizes) <= SLACK
    assert held < 3 * batch.nbytes, held / batch.nbytes


def test_sets_are_handed_out_by_block():
    batch = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array(_texts())], ["doc_id", "text"])
    seen = []
    for out in neardup._sets(iter([batch]), 5):
        assert out.nbytes <= 2 * SLACK
        seen += zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)
    assert [i for i, _ in seen] == list(range(N))
    assert seen[10][1] == seen[11][1] == b"" and len(seen[0][1]) == 8 * 596
    alone = pa.RecordBatch.from_arrays([batch.column(0).slice(4321, 1), batch.column(1).slice(4321, 1)], ["doc_id", "text"])
    assert next(neardup._sets(iter([alone]), 5)).column(1)[0].as_py() == seen[4321][1]


def test_parts_are_whole_texts():
    texts = pa.array(["", None, "é" * 10, "x" * 100, "", "ab", None])
    for size in (1, 20, 50, 1000):
        got = list(B.parts(texts.slice(1), size))
        assert [f for f, _ in got] == list(np.cumsum([0] + [len(p) for _, p in got])[:-1])
        assert [x for _, p in got for x in p.to_pylist()] == texts.to_pylist()[1:]
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= size for _, p in got)
    assert list(B.parts(texts.slice(0, 0))) == []


def test_toxicity_sends_the_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a vile word", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, source string")
    model = toxicity.Model(["vile"])
    model.weights = np.array([1.0, 1, 0, 0, 0, -1])
    alone = toxicity.score(docs, model, ["doc_id"], out="s").orderBy("doc_id").collect()
    sent = []
    run = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: sent.append(self.columns) or run(self, *a, **k))
    for keep in (["doc_id", "text", "source"], ["text", "doc_id"]):
        got = toxicity.score(docs, model, keep, out="s").orderBy("doc_id").collect()
        assert [(r.doc_id, r.text, r.s) for r in got] == [(r.doc_id, d.text, r.s) for r, d in zip(alone, docs.collect(), strict=True)]
        assert sent.pop() == keep


def _held(batches):
    """Largest bytes held at once beyond the batch, by Arrow and numpy; what is handed out is let go."""
    default = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(default)
    _POOLS.append(pool)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        for _ in batches:
            pass
        return pool.max_memory() + tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(default)


def test_token_files_hold_a_block(monkeypatch):
    monkeypatch.setattr(tokenfiles, "_ENCODERS", {})  # goes with the test, before the pools
    texts = _texts()
    texts = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array(texts)], ["doc_id", "text"])
    with open(WORDS, encoding="utf-8") as f:
        tokenizer = SimpleNamespace(value=f.read())
    runs = []
    tokenfiles._tokenized(SimpleNamespace(mapInArrow=lambda run, _: runs.append(run)), tokenizer, 1, 2)
    out = pa.Table.from_batches(list(runs[0](iter([texts])))).combine_chunks()  # pieces of words are kept from here on
    assert out["doc_id"].to_pylist() == list(range(N))
    assert _held(runs[0](iter([texts]))) < 100 * B.BLOCK_BYTES
    ids, = out.select(["doc_id", "ids", "n"]).to_batches()
    assert ids.nbytes > 6 << 20
    assert _held(tokenfiles._frequencies(iter([ids.select(["ids"])]), 2, 1 << 16)) < 3 * B.BLOCK_BYTES
    ranks = SimpleNamespace(value=np.arange(1 << 16, dtype=np.uint32)[::-1].copy())
    assert _held(tokenfiles._packed(iter([ids]), ranks, 2)) < 8 * B.BLOCK_BYTES


def test_token_files_ask_for_batches_by_bytes(spark, monkeypatch, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    with arrow_batches(spark, 1 << 20):
        assert max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()) < 3 << 19
        with arrow_batches(spark, 1):
            assert spark.conf.get(key) == str(1 << 20)  # the limit that is set already
    assert spark.conf.get(key, None) is None

    limits = []
    run = type(docs).mapInArrow
    monkeypatch.setattr(
        type(docs), "mapInArrow", lambda self, *a, **k: limits.append(spark.conf.get(key, None)) or run(self, *a, **k))
    got = tokenfiles.write(docs, WORDS, path=str(tmp_path / "files")).digests()
    assert limits == [str(tokenfiles.BATCH_BYTES)] * 4
    assert spark.conf.get(key, None) is None
    assert got.count() == 3000 and got.agg({"start": "max", "n_tokens": "min"}).first()[:] == (2999 * 1001, 1001)
