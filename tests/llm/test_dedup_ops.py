"""Byte dedup, near duplicates and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from logsieve.llm import bagminhash, bwt_dedup, decontaminate
from logsieve.llm import shingles as S


def brute_bytes(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i:i + length]] = min(first.get(b[i:i + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_bytes(docs, monkeypatch):
    rnd = random.Random(5)
    base = "".join(rnd.choice("ab é") for _ in range(1500))
    line = "the common line that everybody has, thirty words or so, it goes on and on. "
    rows = [(i, base[rnd.randrange(900):][:rnd.randrange(500)] + rnd.choice(["", line, line * 2])
             + base[rnd.randrange(1400):]) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "a" * 900), (503, "a" * 700), (504, "ab" * 300), (505, line[:50]),
             (506, line[:49]), (None, line), (3, line * 3), (3, line * 3), (507, line)]
    monkeypatch.setattr(bwt_dedup, "GROUP", 8)  # grams over several blocks
    found = bwt_dedup.repeated_spans(docs(rows)).drop("removed").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_bytes(rows)
    assert bwt_dedup.repeated_spans(docs([])).count() == 0


def test_suffix_order_and_classes():
    rnd = random.Random(1)
    contexts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 90))) for _ in range(40)] + [b"a" * 80] * 3
    s = np.frombuffer(b"mississippi", dtype=np.uint8)
    assert bwt_dedup.suffix_order(s).tolist() == [10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2]
    of, place, cls = bwt_dedup.equal_windows(contexts, 20)
    seen = {}
    for c, p, k in zip(of, place, cls):
        w = contexts[c][p:p + 20]
        assert len(w) == 20 and seen.setdefault(k, w) == w
    assert len(set(seen.values())) == len(seen)
    assert len(of) == sum(max(0, len(c) - 19) for c in contexts)


def test_windows_of_many_contexts_and_any_bytes():
    # more closing symbols than 16 bits number, all byte values, and a block beyond packed sort keys
    rng = np.random.default_rng(3)
    many = [bytes(x) for x in rng.integers(97, 99, (70_000, 14), dtype=np.uint8)]
    whole = bytes(range(256)) * 2
    large = [bytes(x) for x in rng.integers(0, 3, (1_100, 2_000), dtype=np.uint8)]
    for contexts, length in ((many, 13), ([whole, b"", whole[7:], b"\0" * 90], 50), ([*large, *large[:3]], 50), ([b"ab"], 3)):
        of, place, cls = bwt_dedup.equal_windows(contexts, length)
        windows = [contexts[c][p:p + length] for c, p in zip(of.tolist(), place.tolist())]
        assert len(windows) == sum(max(0, len(c) - length + 1) for c in contexts)
        assert len(set(zip(windows, cls.tolist()))) == len(set(windows)) == len(set(cls.tolist()))
        assert (np.diff(cls) >= 0).all()


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                    root[b] = a
    return sorted((rows[i][0], rows[find(i)][0]) for i in range(len(rows)))


def test_near_duplicates(docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(20, 200))]
        for k in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(k % 4):
                w[rnd.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    hub = [word() for _ in range(100)]
    rows += [(200 + i, " ".join(hub[:90 + i % 7])) for i in range(40)]  # one dense cluster
    rows += [(300, "one two"), (301, "one two"), (302, "one"), (303, None), (304, ""), (305, " \n"),
             (306, "la " * 3000), (307, "la " * 2600), (308, "la " * 2000), (309, "a b c d e"), (309, "a b c d e")]
    want = brute_classes(rows)
    found = bagminhash.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == want
    assert bagminhash.near_duplicates(docs([])).count() == 0
    kept = bagminhash.drop_near_duplicates(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})
    assert kept.columns == docs([]).columns


def test_ids_with_several_texts_and_hubs_in_runs(docs, monkeypatch):
    """Texts of one id are judged one by one; a hub's bag is sent once for a run."""
    monkeypatch.setattr(bagminhash, "RUNS", 3)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    one, two, three = ([word() for _ in range(80)] for _ in range(3))
    near = lambda w, k: " ".join(w[:k] + [word()] + w[k + 1:])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (5, " ".join(two)), (1, near(one, 3)), (9, near(two, 70)), (2, " ".join(three)),
            (None, " ".join(three)), (None, near(three, 1))]
    rows += [(100 + i, near(three, 40 + i % 20)) for i in range(60)]
    found = bagminhash.near_duplicates(docs(rows)).collect()
    got = sorted(((r.doc_id, r.class_id) for r in found), key=str)
    want = [(5, 1), (1, 1), (5, 5), (5, 5), (9, 5), (2, 2), (None, 2), (None, None)] + [(100 + i, 2) for i in range(60)]
    assert got == sorted(want, key=str)
    kept = bagminhash.drop_near_duplicates(docs(rows)).select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(5, rows[1][1]), (1, rows[3][1]), (2, rows[5][1]), (None, rows[7][1])], key=str)
    seen = []
    monkeypatch.setattr(bagminhash, "unpack_bag", lambda b, f=bagminhash.unpack_bag: seen.append(1) or f(b))
    bag = bagminhash.pack_bag(np.arange(5), np.ones(5, dtype=int))
    f = pd.DataFrame({"u": [1] * 9, "v": [1, *range(2, 10)], "side": [0] + [1] * 8, "bag": [bag] * 9})
    out = pd.concat(list(bagminhash._similarities(iter([f]))))
    assert len(seen) == 9 and out["sim"].tolist() == [1.0] * 8


def test_bags_pack():
    for counts in ([], [1, 1], [1, 255], [1, 256, 3], [70_000, 1]):
        items = np.arange(len(counts), dtype=np.uint64) * np.uint64(12345) + (np.uint64(1) << np.uint64(47))
        x, c = bagminhash.unpack_bag(bagminhash.pack_bag(items, np.array(counts, dtype=np.int64)))
        assert (x == items.astype(np.int64)).all() and c.tolist() == counts


def test_bag_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    n, m = 60, 3000
    items = S.mixed(r.integers(1, 2**62, n).astype(np.uint64))
    a, b = r.integers(0, 9, n), r.integers(0, 9, n)
    doc = np.concatenate((np.zeros((a > 0).sum()), np.ones((b > 0).sum()))).astype(int)
    sig = bagminhash.signatures(doc, np.concatenate((items[a > 0], items[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, m)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)


def test_decontamination(docs, spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(k))) for i, k in enumerate([15, 40, 59, 200, 3, 1, 5])]
    items += [(7, None), (8, ""), (9, items[1][1].upper() + "!"), (1, items[1][1])]
    fill = lambda k: " ".join(word() for _ in range(k))
    rows = [(100 + i, f"{fill(rnd.randrange(200))} {t} {fill(rnd.randrange(3000))}") for i, t in items if t]
    w = items[3][1].split()
    rows += [(200, " ".join(w[:170])), (201, " ".join(w[:160])), (202, None), (203, ""), (204, fill(500)),
             (205, ", ".join(items[2][1].split()).title()), (206, " ".join(w[:90] + ["x"] + w[90:]))]

    def grams(words, k):
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())

    want = []
    for i, t in dict.fromkeys(items):
        q = words(t)
        for d, x in rows:
            own = grams(q, min(5, len(q))) if q else set()
            if own and len(own & grams(words(x), min(5, len(q)))) >= 0.8 * len(own):
                want.append((d, i))
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    for limit in (decontaminate.BROADCAST_ROWS, 0):  # both ways to the same result
        found = decontaminate.contained_items(docs(rows), table, broadcast_rows=limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == sorted(want)
    assert decontaminate.contained_items(docs([]), table).count() == 0
    assert decontaminate.contained_items(docs(rows), table.limit(0)).count() == 0
    assert decontaminate.least_hits(16) >= 1
