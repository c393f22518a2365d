"""The Merkle manifest against a plain recomputation, and its paths as proofs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from logsieve.llm import merkle
from logsieve.llm import sha_midstate as M


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def climb(nodes):
    """(root, for every node its (slot, run) by level)."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(place):
            steps[i].append((p % 3, level[p // 3 * 3:p // 3 * 3 + 3]))
            place[i] = p // 3
        level = [digest(*level[k:k + 3]) for k in range(0, len(level), 3)]
    return level[0], steps


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = [climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names]
    root, above = climb([b[0] for b in built])
    out = []
    for s, (sub, below), top in zip(names, built, above):
        for (_, _, own, r), steps in zip(sorted(trees[s], key=lambda x: x[:3]), below):
            steps = steps + top
            others = [h for slot, run in steps for k, h in enumerate(run) if k != slot]
            now, text = own, r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = leaf(r[0], text.replace("\n", ""), *r[2:])
            for slot, run in steps:
                now = digest(*(now if k == slot else h for k, h in enumerate(run)))
            out.append((r[0], own, sub, root, digest(*others), now, now == root))
    return sorted(out, key=str)


def frame(spark, rows):
    clash = ("tree", "part", "run", "pos", "digest", "path", "block", "idx", "top", "rest", "row")
    return spark.createDataFrame(
        [(*r, *["x"] * len(clash)) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))


def test_sha_states():
    rnd = np.random.default_rng(3)
    d = rnd.integers(0, 256, (5, 4, 32), dtype=np.uint8)
    state = np.tile(M.START, (5, 1))
    for k in range(5):
        assert [x.tobytes().hex() for x in M.close(state, k)] == [
            digest(*(d[i, j].tobytes().hex() for j in range(k))) for i in range(5)]
        if k < 4:
            state = M.take_digest(state, d[:, k])


@pytest.mark.parametrize("height", [2, 7])
def test_manifest(spark, height, monkeypatch):
    monkeypatch.setattr(merkle, "BATCH", 32)
    rnd = random.Random(height)
    rows = [(i, "line\n" * rnd.randrange(4) + "é x", "en", rnd.choice(["hot", "hot", "b", "Ä", "", None]), i % 7)
            for i in range(90)]
    rows += [(200, None, None, "lone", None), (201, "", "fr", "b", 0), (None, "a\nb", "en", "b", 3),
             (3, "same\n", "en", "hot", 5), (3, "same\n", "en", "hot", 5), (3, "other", "en", "hot", 5),
             (-4, "w " * 300_000 + "\n", "en", "hot", 1)]
    out = merkle.manifest(frame(spark, rows), merkle.tampered_text(), height)
    got = out.drop("path").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert 0 < sum(r.verified for r in got) < len(got)
    plain = merkle.manifest(frame(spark, rows), None, height).collect()
    assert all(r.verified for r in plain) and len({r.root for r in plain}) == 1


def test_sizes(spark):
    for n in (1, 3, 10):
        rows = [(i, f"t{i}\n", "en", None, i) for i in range(n)]
        got = merkle.manifest(frame(spark, rows), merkle.tampered_text(), 2).drop("path").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_blocks_end_to_end():
    """Several blocks in one batch give the same as one by one."""
    rnd = np.random.default_rng(1)
    sizes, later = np.array([1, 9, 2, 5, 9, 1]), np.array([False, False, True, False, True, True])
    d = rnd.integers(0, 256, (int(sizes.sum()), 32), dtype=np.uint8)
    top, paths, levels = merkle.block_paths(sizes, later, d, 2)
    assert levels.tolist() == [0, 2, 2, 2, 2, 2]
    start = 0
    for k, n in enumerate(sizes):
        one, path, _ = merkle.block_paths(sizes[k:k + 1], later[k:k + 1], d[start:start + n], 2)
        assert (one[0] == top[k]).all() and (path == paths[start:start + n]).all()
        back = merkle.fold(d[start:start + n], path, np.full(n, levels[k]))
        assert (back == top[k]).all()
        start += n
