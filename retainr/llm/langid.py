"""Language identification (operator 4): blended-spectrum presence kernel, Nyström landmarks,
one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams (``ORDERS``; lower-cased, everything but letters a blank), hashed to
``SLOTS`` slots.  k(x, y) = |x ∩ y| / sqrt(|x| |y|).  ``LANDMARKS`` texts span the Nyström space, in
which one ridge regression is solved for each language.  Whole texts are scored, a block of texts
at a time, by two matrix products.

The classifier is fitted on at most ``SAMPLE`` labelled rows, spread evenly over the languages and chosen
by a hash of the id; only their packed n-gram sets (1 KB each) reach the driver.

Edge cases: null texts and texts without letters are ``und`` with score 0; so is everything if no labelled
row exists; rows with null lang or id are never learned from; repeated rows are rows; further columns
pass by; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.llm import blocks as B

ORDERS = (2, 3, 4)
SLOTS = 1 << 13
SAMPLE = 2000
LANDMARKS = 192
RIDGE = 1e-3
SHARPNESS = 4.0
ROWS = 256  # texts in one matrix

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def presence(column: pa.Array):
    """(first row, 0/1 matrix of n-gram slots) for runs of texts."""
    column = pc.utf8_lower(column.cast(pa.large_string()))
    for block in B.blocks(column):
        data = _LETTERS[block.data].astype(B.U64)
        for lo in range(0, len(block), ROWS):
            hi = min(lo + ROWS, len(block))
            begin, end = block.offsets[lo], block.offsets[hi]
            part = data[begin:end]
            row = np.repeat(np.arange(hi - lo), np.diff(block.offsets[lo:hi + 1]))
            out = np.zeros((hi - lo, SLOTS), dtype=np.float32)
            code = np.zeros(len(part), dtype=B.U64)
            for n in range(1, max(ORDERS) + 1):
                size = len(part) - n + 1
                if size <= 0:
                    break
                code = code[:size] * B.U64(257) + part[n - 1:] + B.U64(1)
                if n in ORDERS:
                    whole = row[:size] == row[n - 1:]
                    slot = (code * B.U64(B.BYTE_BASE)) >> B.U64(64 - SLOTS.bit_length() + 1)
                    out[row[:size][whole], slot[whole].astype(np.int64)] = 1
            yield block.first + lo, out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # 0/1, one row each
    weights: np.ndarray  # landmark kernel values -> one output a language

    def kernel(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(
            np.maximum(self.landmarks.sum(axis=1), 1))[None, :]
        return (x @ self.landmarks.T) / norm

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language and its share (0 to 1) for each row."""
        out = (self.kernel(x) @ self.weights).astype(np.float64) * SHARPNESS
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit(sets: np.ndarray, labels: list[str]) -> Model | None:
    """Nyström kernel ridge regression on n-gram sets in a fixed order."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in labels])
    quota = -(-LANDMARKS // len(languages))
    pick = np.sort(np.concatenate([np.flatnonzero(y == c)[:quota] for c in range(len(languages))]))
    model = Model(languages, sets[pick].astype(np.float32), np.zeros(0))
    k_mm = model.kernel(model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([model.kernel(sets[i:i + ROWS].astype(np.float32)) for i in range(0, len(sets), ROWS)]) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1 / np.bincount(y, minlength=len(languages)))[y][:, None]  # languages count alike
    ridge = RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge, phi.T @ (weight * target))
    model.weights = (root @ solved).astype(np.float32)
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the rows of ``docs`` (doc_id, text, lang) with a language and an id."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(2, sample // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, each / n) * (1 << 40)))])
    chosen = known.where(draw < share[F.col("lang")]).select(draw.alias("draw"), "lang", "text")

    def run(batches):
        for batch in batches:
            packed = [row.tobytes() for _, x in presence(batch.column(2)) for row in np.packbits(x > 0, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["draw", "lang", "grams"])

    rows = sorted((r.draw, r.lang, bytes(r.grams)) for r in chosen.mapInArrow(
        run, "draw long, lang string, grams binary").collect())
    sets = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return fit(sets, [r[1] for r in rows])


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    at = len(keep)
    rows = docs.select(*keep, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + ["lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            letters = pc.fill_null(pc.match_substring_regex(batch.column(at), r"\p{L}"), False)
            if m is None:
                letters = pa.array([False] * n)
            else:
                for first, x in presence(batch.column(at)):
                    best[first:first + len(x)], score[first:first + len(x)] = m.predict(x)
            names = pa.array([m.languages[i] for i in best] if m else ["und"] * n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pc.if_else(letters, names, "und"), pc.if_else(letters, pa.array(score), 0.0)],
                [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
