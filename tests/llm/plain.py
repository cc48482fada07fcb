"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    """[(n_shingles, component_id)] for [(doc_id, text)], every pair compared."""
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def spans(text, kinds):
    found = []
    for i, (kind, pattern, ok) in enumerate(kinds):
        found += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
    counts = Counter(f[3] for f in found)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return [counts[k] for k, _, _ in kinds], hashlib.sha256(joined.encode()).hexdigest(), joined


SECRETS = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text):
    return re.sub("[^0-9]", "", text)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m[0])) <= 15),
]


def unigram(docs):
    """[(n_tokens, n_known, train_tokens, base_score)]"""
    tokens = [words(t) + [None] for _, t in docs]
    counts = Counter(w for (d, _), ts in zip(docs, tokens) if crc(d) % 7 != 2 for w in ts)
    n, v = sum(counts.values()), len(counts)
    return [(len(ts), sum(counts[w] > 0 for w in ts), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in ts)) for ts in tokens]


def leaks(docs, items):
    """{(doc_id, item_id)}: an aligned window of min(item, 20) words with at most a fifth replaced, every alignment tried."""
    split = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").translate(LOWER)).split()
    out = set()
    for d, t in docs:
        a = split(t)
        for item, u in items:
            b = split(u)
            size = min(len(b), 20)
            if len(b) < 5:
                continue
            for i in range(len(a) - size + 1):
                for j in range(len(b) - size + 1):
                    if sum(x == y for x, y in zip(a[i:i + size], b[j:j + size])) >= size - size // 5:
                        out.add((d, item))
    return out
