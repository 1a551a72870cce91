"""Plain versions of the repair of conversations, importance resampling and packing, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

_NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
_ROLES = {"u": "user", "a": "assistant"}


def damage(rows):
    """[(conversation, turn, role, text)] after the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, [(role, text)]) of one conversation's rows.

    Every state of the grammar keeps the least (cost, edits) so far, with the edits as a text, and inserts are tried
    until nothing gets better.
    """
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen, counts = [], set(), Counter()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1

    def inserts(best):
        again = True
        while again:
            again = False
            for s, (cost, edits, out) in list(best.items()):
                for c in "ua":
                    if c in _NEXT[s]:
                        way = (cost + 2, edits + "I", [*out, (_ROLES[c], "")])
                        if _NEXT[s][c] not in best or way[:2] < best[_NEXT[s][c]][:2]:
                            best[_NEXT[s][c]] = way
                            again = True
        return best

    best = inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new: dict = {}
        for s, (cost, edits, out) in best.items():
            ways = [(s, (cost + 3, edits + "D", out))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in _NEXT[s]:
                    ways.append((_NEXT[s][role[:1]], (cost + extra, edits + "K", [*out, (role, text)])))
                for c in "ua":
                    if c in _NEXT[s]:
                        ways.append((_NEXT[s][c], (cost + 2 + extra, edits + "R", [*out, (_ROLES[c], text)])))
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = inserts(new)
    cost, edits, out = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, out


def audits(rows):
    """The rows of op11 for [(conversation, turn, role, text)] before damage."""
    groups = defaultdict(list)
    for conv, *row in damage(rows):
        groups[conv].append(row)
    out = []
    for conv in {r[0] for r in rows}:
        *numbers, lines = repaired(groups[conv])
        out.append((conv, *numbers, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return out


def _grams(text, orders=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def resampled(docs, target, percent=5, least=20, buckets=10_000):
    """[(key, n_features, weight, score, rank)] of (key, text)."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in docs for g in _grams(x)[1]), Counter(bucket(g) for x in target for g in _grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        n, grams = _grams(text)
        weight = sum(gain[bucket(g)] for g in grams)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(grams), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def fitted(lengths, window):
    """Used capacities of windows by best fit, longest first."""
    free = []
    for n in sorted(lengths, reverse=True):
        best = min((c for c in free if c >= n), default=None)
        if best is None:
            free.append(window - n)
        else:
            free[free.index(best)] -= n
    return sorted(window - c for c in free)
