"""Plain versions of the contracts, over Python lists."""

from __future__ import annotations

import hashlib
import re
import string
from collections import defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contaminated(docs, items, n=10):
    windows = []
    for item, text in items:
        w = alnum(text)
        size = min(n, len(w))
        windows += [(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size]
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for item, g in set(windows):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return out


def deduplicated(docs, n=35):
    count = defaultdict(int)
    for _, text in docs:
        w = words(text)
        for i in range(len(w) - n + 1):
            count[tuple(w[i : i + n])] += 1
    out = []
    for doc, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def classes(docs, size, percent):
    """(id, set size, smallest id linked) for distinct ids that are not None."""
    sets = {}
    for doc, text in docs:
        w = words((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d)) for d in ids]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]
