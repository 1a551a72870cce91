"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(rows, length):
    """[(key, n_bytes, n_removed, n_spans, sha)] of (key, text)."""
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", gone))
        out.append((k, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def seen_before(rows, length):
    texts = [(k, WORD.findall((t or "").encode())) for k, t in rows]
    low = lambda k: -math.inf if k is None else k
    first: dict = {}
    for k, w in texts:
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, math.inf), low(k))
    out = []
    for k, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < low(k):
                gone[i : i + length] = [True] * length
        out.append((k, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def ngrams(text, n):
    w = WORD.findall((text or "").encode())
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def similar(rows, n, similarity):
    """[(class, links)] in the order of rows (key, text)."""
    sets = [ngrams(t, n) for _, t in rows]
    links = defaultdict(set)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in holders[x]).items():
            if j != i and c >= similarity * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i].add(j)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i] if group[i] == i else []
        while todo:
            x = todo.pop()
            for y in links[x]:
                if group[y] > i:
                    group[y] = i
                    todo.append(y)
    low: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[group[i]] = min(low.get(group[i], k), k)
    return [(low.get(group[i]), len(links[i])) for i in range(len(rows))]


def features(text, window=8):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dups = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - window + 1):
        at[tuple(words[i : i + window])].append(i)
    inside = {p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + window)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(inside)


def scores(text):
    """The five shares that the quality rules judge by."""
    t = text or ""
    n, chars, symbols, dups, repeated = features(t)
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    short, long = sum(len(w.encode()) <= 1 for w in words), sum(len(w.encode()) > 30 for w in words)
    return share(symbols, chars), share(dups, lines), share(repeated, n), share(short, n), share(long, n)


def secrets(text):
    t = text or ""
    assign = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    access = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    hexes = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    spans = sorted(assign + access + hexes, key=lambda x: (x[1], order.index(x[0])))
    return len(assign), len(access), len(hexes), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())


def overlap(docs, items, length=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = fold(t)
        n = min(length, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins[tuple(w[k : k + n])].add(str(i))
    sizes = {len(x) for x in wins}
    out = []
    for k, t in docs:
        w, hit, ids = fold(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    ids |= wins[x]
        out.append((k, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode())))
    return out
