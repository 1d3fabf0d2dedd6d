"""Toxicity (operator 7): Levenshtein automata over a lexicon trie, context windows, logistic score.

Training, on at most ``TOXIC`` + ``CLEAN`` labelled rows chosen by a hash of the id:

1. Lexicon: words and word beginnings whose distinct contexts (word before and after) are far more frequent in
   toxic than in clean texts (log-likelihood ratio and rate ratio).  Contexts, not documents, are counted, so a passage
   that was copied around is one piece of evidence.
2. Every text is scanned for lexicon terms: words within ``EDITS`` edits of a term, found by running a Levenshtein
   automaton over the trie of terms.  Terms match the beginning of a word.
3. Each hit is weighed by its context window: inside quotation marks or next to reporting words it
   counts as quotation, else as abuse.  A logistic regression on the counts gives the score.

Scoring is one pass over whole texts without a shuffle; the lexicon has at most ``TERMS`` terms.

Edge cases: null or empty texts get the score of a text without hits; without labelled rows of both classes nothing is
toxic (score 0); repeated rows are rows; rows with a null id are scored, never learned from; further columns pass by.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.llm import blocks as B

TOXIC, CLEAN = 2000, 3000
TERMS = 1000
EDITS = 1
FUZZY_FROM = 5  # shorter terms allow no edit
SHORTEST, LONGEST = 4, 12  # letters of a term
MIN_CONTEXTS = 4
MIN_EVIDENCE = 12.0
MIN_RATIO = 20.0
WINDOW = 4
THRESHOLD = 0.3
REPORTING = {"quote", "quoted", "said", "says", "wrote", "word", "called", "sagte", "schrieb", "wort", "dit",
             "écrit", "mot", "dijo", "escribió", "palabra"}

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_QUOTES = np.zeros(256, dtype=bool)
_QUOTES[[0x22, 0x27, 0x60]] = True


class Trie:
    """Lexicon terms; ``match`` runs a Levenshtein automaton of the word over it."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def match(self, word: str, edits: int = EDITS) -> tuple[str, int] | None:
        """The term nearest to some beginning of ``word`` and the number of edits."""
        best: tuple[int, str] | None = None
        # a state of the automaton: edits to each beginning of the word
        todo = [(self.root, tuple(range(min(len(word), edits) + 1)), 0)]
        while todo:
            node, state, base = todo.pop()
            for c, child in node.items():
                if c == "":
                    d = min(state)
                    if d == 0 or d <= edits and len(child) >= FUZZY_FROM:
                        best = min(best, (d, child)) if best else (d, child)
                    continue
                # positions base .. base + len(state) - 1 of the word are alive
                nxt, first = [], base
                for j in range(base, min(len(word), base + len(state)) + 1):
                    i = j - base
                    up = state[i] + 1 if i < len(state) else edits + 1
                    diagonal = state[i - 1] + (word[j - 1] != c) if 0 < i <= len(state) else edits + 1
                    left = nxt[-1] + 1 if nxt else edits + 1
                    nxt.append(min(up, diagonal, left))
                while nxt and nxt[0] > edits:
                    nxt.pop(0)
                    first += 1
                while nxt and nxt[-1] > edits:
                    nxt.pop()
                if nxt:
                    todo.append((child, tuple(nxt), first))
        return (best[1], best[0]) if best else None


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self._ready()

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self):
        self.trie, self.seen = Trie(self.terms), {}
        # a word near a term starts with its first two bytes, or holds its last three near their place
        self.heads, self.tails = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        self.sizes = set()
        for t in self.terms:
            b = t.encode()
            self.heads[b[0] << 8 | b[1]] = True
            if len(t) >= FUZZY_FROM:
                self.tails[b[-3] << 16 | b[-2] << 8 | b[-1]] = True
                self.sizes.add(len(b))

    def lookup(self, word: bytes) -> tuple[str, int] | None:
        if word not in self.seen:
            if len(self.seen) > 1 << 18:  # a cache, bounded
                self.seen.clear()
            self.seen[word] = self.trie.match(word.decode("utf-8", "replace"))
        return self.seen[word]

    def candidates(self, block: B.Block) -> np.ndarray:
        """Words that can be near a term."""
        data, s, n = block.data.astype(np.int32), block.starts, block.ends - block.starts
        pad = np.concatenate([data, np.zeros(64, np.int32)])
        ok = (n >= 2) & self.heads[pad[s] << 8 | pad[s + 1]]
        for at in sorted({z - 3 + d for z in self.sizes for d in range(-4, 5) if z - 3 + d >= 0}):
            ok |= (n >= at + 3) & self.tails[pad[s + at] << 16 | pad[s + at + 1] << 8 | pad[s + at + 2]]
        return np.flatnonzero(ok)


FEATURES = 6


def features(column: pa.Array, model: Model) -> np.ndarray:
    """Counts for each text: abuse exact, abuse misspelled, quoted, distinct terms, share of words, one."""
    column = pc.utf8_lower(column.cast(pa.large_string()))
    out = np.zeros((len(column), FEATURES))
    out[:, -1] = 1
    for block in B.blocks(column):
        raw = block.data
        marks = np.concatenate(([0], np.cumsum(_QUOTES[raw])))
        clean = B._block(block.first, _CLEAN[raw], block.offsets)
        terms: dict[int, set] = {}
        rows = np.searchsorted(clean.words, np.arange(len(clean.starts)), side="right") - 1
        for i in model.candidates(clean).tolist():
            s, e, row = clean.starts[i], clean.ends[i], int(rows[i])
            hit = model.lookup(clean.data[s:e].tobytes())
            if hit is None:
                continue
            lo, hi = max(clean.words[row], i - WINDOW), min(clean.words[row + 1], i + WINDOW + 1)
            before = marks[s] - marks[clean.starts[lo]] + _QUOTES[raw[max(clean.starts[lo] - 1, 0)]]
            after = marks[min(clean.ends[hi - 1] + 1, len(raw))] - marks[e]
            near = {clean.data[clean.starts[j]:clean.ends[j]].tobytes().decode("utf-8", "replace") for j in range(lo, hi)}
            quoted = (before > 0 and after > 0) or bool(near & REPORTING)
            f = out[block.first + row]
            f[2 if quoted else (1 if hit[1] else 0)] += 1
            terms.setdefault(row, set()).add(hit[0])
        for row, found in terms.items():
            f = out[block.first + row]
            f[3] = len(found)
            f[4] = f[:3].sum() / max(1, clean.n_words[row])
    out[:, :4] = np.log1p(out[:, :4])
    return out


def _evidence(t: float, c: float, total_t: float, total_c: float) -> tuple[float, float]:
    """Log-likelihood ratio of a term's counts (only if it favours toxic texts) and rate ratio."""
    share = total_t / (total_t + total_c)
    n, p = t + c, t / (t + c)
    if p <= share:
        return 0.0, 1.0
    llr = t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0)
    return llr, ((t + 0.5) / total_t) / ((c + 0.5) / total_c)


def lexicon(rows: list[tuple[str, int, int]], total_t: int, total_c: int) -> list[str]:
    """Terms from (beginning, contexts in toxic texts, in clean texts): the shortest beginnings with enough
    evidence, lengthened while nearly all their evidence goes on with the same letter."""
    counts = {w: (t, c) for w, t, c in rows}
    good = {w for w, (t, c) in counts.items() if t >= MIN_CONTEXTS
            and (e := _evidence(t, c, total_t, total_c))[0] >= MIN_EVIDENCE and e[1] >= MIN_RATIO}
    longer: dict[str, list[str]] = {}
    for w in counts:
        longer.setdefault(w[:-1], []).append(w)
    out = []
    for w in sorted(good, key=lambda w: (len(w), w)):
        if any(w[:n] in good for n in range(SHORTEST, len(w))):
            continue
        evidence = counts[w][0]
        while (nxt := [x for x in longer.get(w, ()) if counts[x][0] >= 0.95 * counts[w][0]]) and len(w) < LONGEST:
            w = nxt[0]
        out.append((evidence, w))
    return [w for _, w in sorted(out, key=lambda x: (-x[0], x[1]))[:TERMS]]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-4
    total = weight / weight.sum() * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (total * (p - y)) + ridge * w
        hess = (x * (total * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _context(words: list[str], i: int) -> int:
    around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
    return zlib.crc32(around.encode()) << 20 | len(around) & 0xFFFFF


def _words(batches):
    """Distinct (beginning, context) of each class, from (text, toxic)."""
    for batch in batches:
        toxic = np.asarray(batch.column(1))
        seen = set()
        column = pc.utf8_lower(batch.column(0).cast(pa.large_string()))
        for block in B.blocks(column):
            clean = B._block(block.first, _CLEAN[block.data], block.offsets)
            for row in range(len(clean)):
                words = clean.text_bytes(row).decode().split()
                bad = int(toxic[block.first + row])
                for i, w in enumerate(words):
                    if len(w) >= SHORTEST:
                        around = _context(words, i)
                        seen.add((w[:LONGEST], around, bad))
        cols = list(zip(*seen, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.int32())], ["word", "around", "toxic"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """Fit on labelled rows: docs (doc_id, text), labels (doc_id, toxic 0/1)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # about toxic + clean ids: bounded whatever the input, so they may be broadcast
    ids = known.where(draw < F.when(F.col("toxic") == 1, min(1.0, toxic / n[1])).otherwise(min(1.0, clean / n[0])))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    contexts = sample.mapInArrow(_words, "word string, around long, toxic int").groupBy("word", "around").agg(
        F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    total = F.sum("t").alias("t"), F.sum("c").alias("c")
    words = contexts.groupBy("word").agg(*total)
    starts = words.select(F.explode(F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))),
        lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("start"), "t", "c")
    starts = starts.groupBy("start").agg(*total)
    all_t, all_c = words.agg(F.sum("t"), F.sum("c")).first()
    if not all_t or not all_c:
        return None
    # only what can become a term comes to the driver
    ratio = ((F.col("t") + 0.5) / all_t) / ((F.col("c") + 0.5) / all_c)
    rows = [tuple(r) for r in starts.where((F.col("t") >= MIN_CONTEXTS) & (ratio >= MIN_RATIO)).orderBy(
        F.desc("t"), "start").limit(50 * TERMS).collect()]
    model = Model(lexicon(rows, all_t, all_c))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = features(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = sorted((r.toxic, tuple(r.x)) for r in sample.mapInArrow(run, "x array<double>, toxic int").collect())
    y = np.array([r[0] for r in got], dtype=float)
    x = np.array([r[1] for r in got])
    share = np.where(y == 1, n[1] / max(1, y.sum()), n[0] / max(1, (1 - y).sum()))
    model.weights = _logistic(x, y, share)
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", out: str = "toxicity") -> DataFrame:
    """The columns ``keep`` with ``out``, the score (0 to 1)."""
    # the text goes to the workers once, also when it is kept
    at = keep.index(text) if text in keep else len(keep)
    n = len(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{out}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            p = np.zeros(batch.num_rows) if m is None else 1 / (1 + np.exp(-np.clip(
                features(batch.column(at), m) @ m.weights, -30, 30)))
            done = pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(p)], [*keep, out])
            for first, part in B.parts(batch.column(at)):
                yield done.slice(first, len(part))

    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)
