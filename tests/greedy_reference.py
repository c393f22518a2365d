"""Slow pure-Python near-duplicate trim written from the operator definition
(normalise, pairwise rules, greedy leader pass). Used as the oracle for small
fixtures only: it is quadratic per level."""

from __future__ import annotations

import re

from logsieve.plans.oracle import NORMALIZE_RULES

_RULES = [(re.compile(p, re.ASCII), r) for p, r in NORMALIZE_RULES]
_WS = re.compile(r"[\t\n\f\r ]+")
_GO_SPACE = "\t\n\x0b\f\r \x85\xa0                　"


def normalize(msg: str) -> str:
    out = msg.lower()
    for rx, repl in _RULES:
        out = rx.sub(repl, out)
    return _WS.sub(" ", out).strip(_GO_SPACE)


def lev(a: bytes, b: bytes) -> int:
    if len(a) > len(b):
        a, b = b, a
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a):
        cur = [i + 1]
        for j, cb in enumerate(b):
            cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (ca != cb)))
        prev = cur
    return prev[-1]


def string_similarity(s1: str, s2: str) -> float:
    if s1 == s2:
        return 1.0
    a, b = s1.lower().encode(), s2.lower().encode()
    m = max(len(a), len(b))
    if m == 0:
        return 1.0
    return 1.0 - lev(a, b) / m


def similar(m1: str, m2: str, thr: float = 0.8) -> bool:
    if m1 == m2:
        return True
    l1, l2 = len(m1.encode()), len(m2.encode())
    if min(l1, l2) / max(l1, l2) > 0.5:
        if m2 in m1 or m1 in m2:
            return True
    else:
        return False
    w1, w2 = m1.split(), m2.split()
    if max(len(w1), len(w2)) and min(len(w1), len(w2)) / max(len(w1), len(w2)) < 0.5:
        return False
    s1 = set(w1)
    common = sum(1 for w in w2 if w in s1)
    total = len(s1) + len(w2) - common
    if total == 0:
        return False
    j = common / total
    if j >= thr:
        return True
    if j >= thr * thr:
        return string_similarity(m1, m2) >= thr
    return False


def source_similar(a: str, b: str) -> bool:
    return a.lower() == b.lower() or (len(a) > 0 and len(b) > 0 and string_similarity(a, b) > 0.7)


def greedy(rows):
    """rows: list of (key, level, source, message) in input order ->
    list of (key, duplicate_count) for the leaders."""
    norm = [normalize(r[3]) for r in rows]
    claimed = [False] * len(rows)
    out = []
    for i, (key, lvl, src, _msg) in enumerate(rows):
        if claimed[i]:
            continue
        claimed[i] = True
        count = 1
        for j in range(i + 1, len(rows)):
            if claimed[j] or rows[j][1].lower() != lvl.lower():
                continue
            if not source_similar(src, rows[j][2]):
                continue
            if similar(norm[i], norm[j]):
                claimed[j] = True
                count += 1
        out.append((key, count))
    return out
