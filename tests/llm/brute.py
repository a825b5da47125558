"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import string
from collections import Counter, defaultdict

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def near(rows, words, percent=80):
    """{doc_id: (set size, component)}; links by an inverted index of shingles."""
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(ws[k : k + words]) for k in range(max(1, len(ws) - words + 1))} if ws else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text):
    found = []
    for j, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                found.append((m.start(), j, kind, m.end()))
    found.sort()
    return [sum(f[1] == j for f in found) for j in range(4)], hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in found).encode()).hexdigest()
