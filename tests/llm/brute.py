"""Plain versions of the operators' contracts, one document at a time."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def substrings(docs, k=20):
    """{doc_id: (n_words, n_removed, sha256)}"""
    seen, out = set(), {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            if key in seen:
                gone[s:s + k] = [True] * k
            seen.add(key)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, percent=85):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(min(a, b), max(a, b)) for h in holders.values() for a in h for b in h if a != b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def luhn(s):
    d = [int(x) for x in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    """Counts by kind and the digest of the base spans."""
    spans, counts = [], []
    for kind, pattern in PII.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                n += 1
        counts.append(n)
    return counts, ",".join(spans)


def clean(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (text or "").lower()).split()


def best_distance(pattern, text):
    """Smallest edit distance of a word sequence to any part of another."""
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        nxt = [0]
        for j, p in enumerate(pattern, 1):
            nxt.append(min(row[j - 1] + (p != c), row[j] + 1, nxt[j - 1] + 1))
        row, best = nxt, min(best, nxt[-1])
    return best


def leaks(docs, items, rate=0.15):
    """{(doc_id, item_id): edits}"""
    out = {}
    texts = {i: clean(t) for i, t in docs.items()}
    for item, text in items:
        p = clean(text)
        e = int(len(p) * rate)
        for i, w in texts.items():
            if p and len(set(p) & set(w)) >= len(set(p)) - e:
                d = best_distance(p, w)
                if d <= e:
                    out[i, item] = d
    return out


def targets(sizes):
    """{source: target} by sharing again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        nxt = [i]
        for j, d in enumerate(b, 1):
            nxt.append(min(row[j - 1] + (c != d), row[j] + 1, nxt[-1] + 1))
        row = nxt
    return row


def near_prefix(term, word):
    """Smallest number of edits between a term and any beginning of a word."""
    return min(edits(term, word))
