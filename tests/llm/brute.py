"""Brute-force versions of the operators' contracts, over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """doc_id -> (set size, least id reachable by links), every pair compared."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i:i + 5])].append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def licences(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    places = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))


def secrets(t):
    t, kinds = t or "", ("assign", "access", "hex")
    found = [[m.span() for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A)
        if len(m[2]) >= 12],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18],
        [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]]
    spans = sorted((s, k, e) for k, v in enumerate(found) for s, e in v)
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    return *map(len, found), hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(",")))


def base_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update(WORD.findall(lower(t)))
            train[""] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        w = WORD.findall(lower(t)) + [""]
        out.append((i, held(i), len(w), sum(train[x] > 0 for x in w), n,
                    sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out
