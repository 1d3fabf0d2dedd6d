"""LM scoring (operator 2): masked pseudo-likelihood with a bidirectional window network.

Every word has a class: the ``TOP`` most frequent words have their own, other words that of their last three bytes (the
``ENDINGS`` most frequent ones), else that of their last byte (``LASTS``), the rest share one.  A token's probability
given both sides is the mean of one estimate from each side,

    (n(before, word) - 1 + MU * q) / (n(before) - 1 + MU)    and the same with the word after,

where q = p(class | classes before and after) * p(word | class).  The first factor mixes two networks with one hidden
layer, one over the adjacent classes and one over those two words away, trained in numpy; the second is smoothed by counts.
The token itself is masked: counts are taken without it (the -1), so a pair or a word seen nowhere else is as
unknown as a new one.  The end of a text counts as an outcome of its last word.  A text's score is the sum of the logarithms.

Training covers every token of the corpus.  The networks see a token only through three classes, so the
counts of the triples are sufficient: tasks count them, Spark adds them up by key, and at most 2 * ``CLASSES**3``
sums reach the driver, where full-batch gradient steps on them equal steps on all tokens.  Words and pairs are
counted by their full 64-bit hash in Parquet tables in the shared folder; these grow with the corpus and never reach
the driver.  Pairs seen once are left out: without their own token their count is 0.

Scoring deals the texts to chunks; a chunk asks for its distinct words and pairs by range of hash (``buckets``), each once,
and is answered in the order asked, so that a frequent key is one row a chunk however often it occurs.

Edge cases: null or empty texts have no tokens and score 0; further columns pass by; repeated rows are scored and
counted each (rows alike in all kept columns and the text share a chunk); without words nothing is learned and all
classes count alike; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.llm import blocks as B
from retainr.llm.shared import stored

TOP, ENDINGS, LASTS = 40, 32, 22
CLASSES = TOP + ENDINGS + LASTS + 2  # one for the edge of a text (0), one for all other words
HIDDEN, STEPS, RATE = 48, 300, 0.02
OUTER = 0.2  # weight of the network over the classes two words away
MU = 20.0
SMOOTHS = tuple(0.01 * 1.5**i for i in range(20))  # the one that fits best is taken
BUCKET_TOKENS, CHUNK_BYTES = 1 << 21, 1 << 23

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _tokens(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and its last three bytes as a number (a byte that is missing counts 0)."""
    block.data = _FOLD[block.data]
    tails = np.zeros(len(block.starts), np.int64)
    for back in (1, 2, 3):
        at = block.ends - back
        tails |= np.where(at >= block.starts, block.data[np.maximum(at, 0)], 0).astype(np.int64) << 8 * (back - 1)
    return block.word_hashes(), tails


def _pairs(block: B.Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of (word, next word) at each word, and whether there is a next word in the text."""
    inner = np.zeros(len(words), bool)
    inner[:-1] = True
    inner[block.words[1:][block.n_words > 0] - 1] = False
    after = np.zeros_like(words)
    after[:-1] = words[1:]
    return B.mix64(words * B.U64(B.WORD_BASE) + after), inner


class _Gathered:
    """Counts by key over many blocks, combined whenever enough have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.kept = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * self.kept + (1 << 20):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts] or [np.empty(0, B.U64)])
        counts = np.concatenate([n for _, n in self.parts] or [np.empty(0, np.int64)])
        self.parts = [_summed_by(keys, counts)]
        self.size = self.kept = len(self.parts[0][0])
        return self.parts[0]


def _summed_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash: sorted keys are sorted by bucket too."""
    return ((keys >> B.U64(32)) * B.U64(buckets) >> B.U64(32)).astype(np.int64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte, lowest bytes first: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _packed(np.diff(keys, prepend=B.U64(0)))


def _unpacked_keys(data: pa.BinaryScalar) -> np.ndarray:
    return np.cumsum(_unpacked(data, B.U64), dtype=B.U64)


def _sql_bucket(buckets: int):
    return F.floor(F.shiftrightunsigned("key", 32) * F.lit(buckets) / F.lit(float(1 << 32))).cast("int")


def _sparse(total: np.ndarray, kind: int) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(total[at])], ["kind", "cell", "n"])


@dataclass
class Model:
    top: np.ndarray  # hashes of the words with a class of their own (1, 2, ...), sorted
    endings: np.ndarray  # endings with a class (1 + TOP, ...), sorted
    last_class: np.ndarray  # class by last byte
    log_class: np.ndarray  # [distance - 1, before, after, class]
    n_class: np.ndarray  # tokens by class
    n_distinct: np.ndarray  # words by class
    smooth: float
    buckets: int
    counts: DataFrame | None = None  # kind (0 words, 1 pairs), key, n, tail (of words)

    def __getstate__(self):
        return {**self.__dict__, "counts": None}

    def classes(self, words: np.ndarray, tails: np.ndarray) -> np.ndarray:
        c = self.last_class[tails & 255]
        for known, first, values in ((self.endings, 1 + TOP, tails), (self.top, 1, words)):
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                c = np.where(known[at] == values, first + at, c)
        return c

    def p_word(self, classes: np.ndarray, n: np.ndarray, masked: int) -> np.ndarray:
        """p(word | class) of words counted n times, without ``masked`` of the occurrences."""
        own = (classes >= 1) & (classes <= TOP)
        p = (np.maximum(n - masked, 0) + self.smooth) / (
            np.maximum(self.n_class[classes] - masked, 0) + self.smooth * (self.n_distinct[classes] + 1))
        return np.where(own, 1.0, p)

    @property
    def log_word(self) -> np.ndarray:
        """[class, word] over all words and one not seen; collects the vocabulary, for small corpora."""
        rows = self.counts.where("kind = 0").select("key", "n", "tail").toPandas()
        keys = rows.key.to_numpy(np.int64)
        c = self.classes(B.unsigned(keys), rows["tail"].to_numpy(np.int64))
        p = np.zeros((CLASSES, len(rows) + 1))
        p[c, np.arange(len(rows))] = self.p_word(c, rows.n.to_numpy(np.int64), 0)
        every = np.arange(CLASSES)
        p[:, -1] = self.p_word(every, np.zeros(CLASSES), 0)
        p[1:1 + len(self.top), -1] = 0
        with np.errstate(divide="ignore"):
            return np.log(p)


def _neighbours(block: B.Block, classes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.zeros_like(classes), np.zeros_like(classes)
    row = block.row_of_word
    same = row[distance:] == row[:-distance]
    before[distance:][same], after[:-distance][same] = classes[:-distance][same], classes[distance:][same]
    return before, after


def _network(triples: np.ndarray) -> np.ndarray:
    """log p(class | before, after) for all pairs of neighbours, trained on the counts [before, after, class]."""
    rng = np.random.default_rng(7)
    total = max(1.0, triples.sum())
    every = np.stack(np.meshgrid(np.arange(CLASSES), np.arange(CLASSES), indexing="ij"), -1).reshape(-1, 2)
    target = (triples.reshape(-1, CLASSES) / total).astype(np.float32)
    met = target.any(axis=1)  # other pairs have no gradient
    pairs, target = every[met], target[met]
    mass = target.sum(axis=1, keepdims=True)
    sides = [np.eye(CLASSES, dtype=np.float32)[pairs[:, k]].T for k in (0, 1)]
    unigram = (triples.sum(axis=(0, 1)) + 1) / (total + CLASSES)
    p = {"l": rng.normal(0, 0.1, (CLASSES, HIDDEN)), "r": rng.normal(0, 0.1, (CLASSES, HIDDEN)), "b": np.zeros(HIDDEN),
         "w": rng.normal(0, 0.1, (HIDDEN, CLASSES)), "c": np.log(unigram)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def forward(pairs: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        q = {k: x.astype(kind) for k, x in p.items()}
        h = np.tanh(q["l"][pairs[:, 0]] + q["r"][pairs[:, 1]] + q["b"])
        z = h @ q["w"] + q["c"]
        z -= z.max(axis=1, keepdims=True)
        return h, z

    for step in range(1, STEPS + 1):
        h, z = forward(pairs, np.float32)
        d = np.exp(z, out=z)
        d *= mass / d.sum(axis=1, keepdims=True)
        d -= target
        back = (d @ p["w"].T.astype(np.float32)) * (1 - h * h)
        grad = {"w": h.T @ d, "c": d.sum(axis=0), "l": sides[0] @ back, "r": sides[1] @ back, "b": back.sum(axis=0)}
        for k, g in grad.items():
            g = g.astype(np.float64)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    z = forward(every, np.float64)[1]
    return (z - np.log(np.exp(z).sum(axis=1, keepdims=True))).reshape(CLASSES, CLASSES, CLASSES)


def _asked(columns: list[pa.Array]) -> list[tuple[int, np.ndarray]]:
    """Distinct words (kind 0) and pairs (1) of the texts."""
    words, pairs = _Gathered(), _Gathered()
    for column in columns:
        for block in B.blocks(column):
            w, _ = _tokens(block)
            if len(w):
                key, inner = _pairs(block, w)
                words.add(w)
                pairs.add(key[inner])
    return [(0, words.total()[0]), (1, pairs.total()[0])]


def _top(counts: DataFrame, key: str, limit: int) -> np.ndarray:
    """The most frequent values in the order of frequency."""
    rows = counts.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(limit).collect()
    return np.array([r[0] for r in rows], np.int64)


def _count_words(rows: DataFrame) -> DataFrame:
    """Words by full hash: key, tail, n."""

    def run(batches):
        for batch in batches:
            words, tails, counts = [], [], []
            for block in B.blocks(batch.column(0)):
                w, t = _tokens(block)
                keys, first, n = np.unique(w, return_index=True, return_counts=True)
                words.append(keys)
                tails.append(t[first])
                counts.append(n)
            if words:
                keys, first = np.unique(np.concatenate(words), return_index=True)
                n = _summed_by(np.concatenate(words), np.concatenate(counts))[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(B.signed(keys)), pa.array(np.concatenate(tails)[first]), pa.array(n)], ["key", "tail", "n"])

    counted = rows.mapInArrow(run, "key long, tail long, n long")
    return counted.groupBy("key").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _count_pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """Pairs seen more than once, by full hash: key, n."""

    def send(batches):
        pairs = _Gathered()
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                w, _ = _tokens(block)
                if len(w):
                    key, inner = _pairs(block, w)
                    pairs.add(key[inner])
            if pairs.size > 1 << 22:
                yield from packed(pairs)
                pairs = _Gathered()
        yield from packed(pairs)

    def packed(pairs):
        keys, n = pairs.total()
        cuts = _cuts(keys, buckets)
        rows = [(b, _packed_keys(keys[x:y]), _packed(n[x:y]))
                for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        if rows:
            b, k, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())],
                                             ["bucket", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked_keys(x) for x in table.column("keys")])
        counts = np.concatenate([_unpacked(x, np.int64) for x in table.column("counts")])
        keys, n = _summed_by(keys, counts)
        again = n > 1
        return pa.table([pa.array(B.signed(keys[again])), pa.array(n[again])], ["key", "n"])

    sent = rows.mapInArrow(send, "bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "key long, n long")


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fit on every token of ``docs``."""
    spark, rows = docs.sparkSession, docs.select(text)
    words = stored(_count_words(rows), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_TOKENS))
    pairs = stored(_count_pairs(rows, buckets), "pairs")
    counts = words.select(F.lit(0).alias("kind"), "key", "n", "tail").unionByName(
        pairs.select(F.lit(1).alias("kind"), "key", "n", F.lit(None).cast("long").alias("tail")))

    top = np.sort(B.unsigned(np.array([r.key for r in words.orderBy(F.desc("n"), "key").limit(TOP).collect()], np.int64)))
    rest = words.where(~F.col("key").isin([int(k) for k in B.signed(top)])) if len(top) else words
    endings = np.sort(_top(rest, "tail", ENDINGS))
    others = rest.where(~F.col("tail").isin([int(k) for k in endings])) if len(endings) else rest
    lasts = _top(others.withColumn("last", F.col("tail").bitwiseAND(F.lit(255))), "last", LASTS)
    last_class = np.full(256, CLASSES - 1, np.int64)
    last_class[lasts] = 1 + TOP + ENDINGS + np.arange(len(lasts))
    model = Model(top, endings, last_class, np.zeros(0), np.zeros(CLASSES, np.int64),
                  np.zeros(CLASSES, np.int64), 0.0, buckets)
    shared = spark.sparkContext.broadcast(model)

    def triples(batches):
        cells = np.zeros((2, CLASSES**3), np.int64)
        m = shared.value
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                c = m.classes(*_tokens(block))
                if len(c):
                    for k in (0, 1):
                        before, after = _neighbours(block, c, k + 1)
                        cells[k] += np.bincount((before * CLASSES + after) * CLASSES + c, minlength=CLASSES**3)
        yield _sparse(cells[0], 0)
        yield _sparse(cells[1], 1)

    found = rows.mapInArrow(triples, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros((2, CLASSES**3))
    cells[found.kind.to_numpy(), found.cell.to_numpy()] = found.n.to_numpy()
    cells = cells.reshape(2, CLASSES, CLASSES, CLASSES)
    model.log_class = np.stack([_network(x) for x in cells]).astype(np.float32)
    model.n_class = cells[0].sum(axis=(0, 1)).astype(np.int64)

    def by_class(batches):
        m = shared.value
        for batch in batches:
            c = m.classes(B.unsigned(batch.column(0).to_numpy()), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(2)], ["class", "n"])

    # how many words of a class are counted n times: all that the smoothing depends on
    seen = words.select("key", "tail", "n").mapInArrow(by_class, "class long, n long").groupBy("class", "n").count().toPandas()
    c, n, many = (seen[x].to_numpy(np.int64) for x in ("class", "n", "count"))
    np.add.at(model.n_distinct, c, many)

    def fit(smooth: float) -> float:
        model.smooth = smooth
        return float((many * n * np.log(model.p_word(c, n, 1))).sum())

    model.smooth = max(SMOOTHS, key=fit)
    model.counts = counts
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, log_likelihood (sum over the tokens) and mean_log_likelihood (0 without
    tokens)."""
    at, buckets = len(keep), model.buckets
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + ["n_tokens long", "log_likelihood double", "mean_log_likelihood double"])
    bytes_ = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(12, -(-bytes_ // CHUNK_BYTES))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(chunks)).cast("int"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ask(table: pa.Table) -> pa.Table:
        out = []
        for kind, keys in _asked(table.column("__text").chunks):
            cuts = _cuts(keys, buckets)
            out += [(kind, b, _packed_keys(keys[x:y])) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        kinds, to, sent = zip(*out, strict=True) if out else ((), (), ())
        chunk = table.column("__chunk")[0].as_py()
        return pa.table([pa.array(kinds, pa.int32()), pa.array(to, pa.int32()), pa.array([chunk] * len(out), pa.int32()),
                         pa.array(sent, pa.binary())], ["kind", "bucket", "chunk", "keys"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = B.unsigned(known.column("key").to_numpy())
        order = np.argsort(keys)
        keys, n = keys[order], known.column("n").to_numpy()[order]
        out = []
        for x in asked.column("keys"):
            want = _unpacked_keys(x)
            found = np.zeros(len(want), np.int64)
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                found = np.where(keys[pos] == want, n[pos], 0)
            out.append(_packed(found))
        return pa.table([asked.column("chunk"), asked.column("kind"), asked.column("bucket"), pa.array(out, pa.binary())],
                        ["chunk", "kind", "bucket", "counts"])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        m = shared.value
        order = np.lexsort((answers.column("bucket").to_numpy(), answers.column("kind").to_numpy()))
        kinds, got = answers.column("kind").to_numpy()[order], answers.column("counts").take(order)
        counts = [np.concatenate([_unpacked(x, np.int64) for x, k in zip(got, kinds, strict=True) if k == kind]
                                 or [np.empty(0, np.int64)]) for kind in (0, 1)]
        (_, words), (_, pairs) = _asked(table.column("__text").chunks)
        n, total, base = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows), 0
        for column in table.column("__text").chunks:
            for block in B.blocks(column):
                w, t = _tokens(block)
                if len(w):
                    p = np.log(_probabilities(m, block, w, t, words, pairs, counts))
                    rows = slice(base + block.first, base + block.first + len(block))
                    n[rows] = block.n_words
                    total[rows] = [p[a:b].sum() for a, b in zip(block.words, block.words[1:], strict=False)]
            base += len(column)
        return pa.table([*table.columns[:at], pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], names)

    names = [*keep, "n_tokens", "log_likelihood", "mean_log_likelihood"]

    asked = rows.groupBy("__chunk").applyInArrow(ask, "kind int, bucket int, chunk int, keys binary")
    known = model.counts.select("kind", _sql_bucket(buckets).alias("bucket"), "key", "n")
    answers = asked.groupBy("kind", "bucket").cogroup(known.groupBy("kind", "bucket")).applyInArrow(
        answer, "chunk int, kind int, bucket int, counts binary")
    return rows.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _probabilities(m: Model, block: B.Block, w, tails, words, pairs, counts) -> np.ndarray:
    """Of each token given both sides, itself masked."""
    c = m.classes(w, tails)
    n = counts[0][np.searchsorted(words, w)]
    q = np.zeros(len(w))
    for k, weight in ((0, 1 - OUTER), (1, OUTER)):
        before, after = _neighbours(block, c, k + 1)
        q += weight * np.exp(m.log_class[k, before, after, c])
    q *= m.p_word(c, n, 1)
    key, inner = _pairs(block, w)
    both = np.zeros(len(w))  # n(word, next word) - 1
    if len(pairs):
        both[inner] = np.maximum(counts[1][np.searchsorted(pairs, key[inner])] - 1, 0)
    others = np.maximum(n - 1, 0)
    p = np.empty((2, len(w)))
    p[:] = q
    first = np.flatnonzero(inner)
    p[0, first + 1] = (both[first] + MU * q[first + 1]) / (others[first] + MU)
    p[1, first] = (both[first] + MU * q[first]) / (others[first + 1] + MU)
    return p.mean(axis=0)
