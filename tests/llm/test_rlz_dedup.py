"""Word passage dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from logsieve.llm import rlz_dedup as R
from logsieve.llm import shingles as S


def brute(rows, length=13):
    first, split = {}, []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        split.append(w)
        for i in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[i:i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i:i + length])] < d:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    base = [rnd.choice(["a", "b", "é", "d\x1cd", "e\x85"]) + str(rnd.randrange(12)) for _ in range(400)]
    line = "the common passage that everybody has on its page with some more words after it all".split()
    rows = []
    for i in range(80):
        a, b = rnd.randrange(380), rnd.randrange(390)
        w = base[a:a + rnd.randrange(60)] + rnd.choice([[], line, line * 2]) + base[b:b + rnd.randrange(40)]
        if w and rnd.random() < 0.5:
            w[rnd.randrange(len(w))] = f"new{i}"
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    same = " ".join(line)
    return rows + [(500, None), (501, ""), (502, "x " * 300), (503, "x " * 200), (504, "p q " * 100),
                   (505, same), (506, " ".join(line[:13])), (507, " ".join(line[:12])), (None, same), (3, same * 3),
                   (3, same + " " + same), (3, same + " " + same), (508, " \n "), (509, " ".join(base * 40)),
                   (510, " ".join(base * 40))]


@pytest.mark.parametrize("case", ["plain", "dealt", "frequent"])
def test_passages(docs, case, monkeypatch):
    rows = corpus(len(case))
    if case == "dealt":
        monkeypatch.setattr(R, "GROUP", 4)
        monkeypatch.setattr(R, "BLOCK_WORDS", 200)
    if case == "frequent":
        from functools import partial
        monkeypatch.setattr(R, "frequent_grams", partial(R.frequent_grams, share=0.0))
        monkeypatch.setattr(R, "GROUP", 8)
    found = R.repeated_passages(docs(rows).repartition(5)).drop("removed").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_empty(docs):
    assert R.repeated_passages(docs([])).count() == 0
    assert [r.n_words for r in R.repeated_passages(docs([(1, None)])).collect()] == [0]


def test_factors():
    """Factors are the longest matches with a smaller document, and leave no window out."""
    rnd = random.Random(9)
    contexts = [[rnd.randrange(3) for _ in range(rnd.randrange(30))] for _ in range(60)]
    docs = np.array([rnd.randrange(25) for _ in contexts])
    block = R.Reference([np.array(c, dtype=np.uint64) for c in contexts], docs, 30)
    for i, c in enumerate(contexts):
        for p in range(len(c)):
            best = 0
            for j, o in enumerate(contexts):
                if docs[j] < docs[i]:
                    for q in range(len(o)):
                        k = 0
                        while p + k < len(c) and q + k < len(o) and c[p + k] == o[q + k]:
                            k += 1
                        best = max(best, k)
            assert block.longest(np.array([block.starts[i] + p]), docs[i:i + 1])[0] == best
    of, lo, hi = R.factor([np.array(c, dtype=np.uint64) for c in contexts], docs, 5)
    covered = {(i, p) for i, a, b in zip(of, lo, hi) for p in range(a, b - 4)}
    want = {(i, p) for i, c in enumerate(contexts) for p in range(len(c) - 4)
            if any(docs[j] < docs[i] and c[p:p + 5] in [o[q:q + 5] for q in range(len(o) - 4)]
                   for j, o in enumerate(contexts))}
    assert covered == want


def test_anchors():
    """Equal windows hold an equal gram at the same place."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))).encode() for _ in range(30)]
    words, first = S.word_hashes(texts, S.SPACES)
    of, at, g, _ = R.anchors(words, first, 13, 5)
    held = set(zip(of.tolist(), at.tolist()))
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - 12):
            inside = frozenset(k - p for k in range(p, p + 9) if (i, k) in held)
            assert inside
            grams = {x for x in inside}
            key = tuple(w[p:p + 13])
            seen.setdefault(key, grams)
            assert seen[key] & grams
