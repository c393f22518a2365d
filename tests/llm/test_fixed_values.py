"""Small checks of the shared pieces."""

import numpy as np
import pytest

from logsieve.llm import decontaminate, langid, mixing, sampling
from logsieve.llm import shingles as S
from logsieve.llm.components import components


def test_word_and_shingle_hashes_follow_the_words():
    texts = [b"a bb a bb a bb", b"", b"  a\tbb\x0ba ", b"a", b"bb a"]
    words, first = S.word_hashes(texts, S.SPACES)
    assert np.diff(first).tolist() == [6, 0, 3, 1, 2]
    assert words[0] == words[2] == words[6] and words[1] == words[7] != words[0]
    h, of = S.shingle_hashes(words, first, 5)
    assert np.bincount(of, minlength=5).tolist() == [2, 0, 1, 1, 1]
    assert len(set(h.tolist())) == 5
    same, _ = S.shingle_hashes(*S.word_hashes([b"x y z u v", b"x  y z\nu v"], S.SPACES))
    assert same[0] == same[1]


def test_batches_cover_every_text():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 5]
    got = list(S.batches(texts, 20))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert list(S.batches([], 20)) == []


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(900 + i, 901 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(x.node, x.root) for x in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bounded_sample(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    once = {(r.doc_id, r.lang, r.group_n) for r in sampling.bounded_sample(df, "lang", 100).collect()}
    again = {(r.doc_id, r.lang, r.group_n) for r in sampling.bounded_sample(df.repartition(7), "lang", 100).collect()}
    assert once == again
    big = [x for x in once if x[1] == "big"]
    assert len(big) == 100 and {x[2] for x in big} == {2700}


def test_grams_do_not_depend_on_the_batch():
    a, s = langid.grams(["Élan vital", "x", ""])
    b, _ = langid.grams(["x"])
    assert (a[s[1]:s[2]][:, 0] == b[:, 0]).all() and len(a) == s[-1]


def test_least_hits_bound():
    from math import comb
    for width in (4, 16):
        h = decontaminate.least_hits(width)
        miss = sum(comb(width, k) * 0.8**k * 0.2**(width - k) for k in range(h))
        assert h == 1 or miss <= decontaminate.MISS


def test_targets_add_up(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, None, 300), (4, "é", 5)],
                                  "doc_id long, source string, size long")
    got = mixing.targets(sizes).collect()
    assert sum(r.target for r in got) == pytest.approx(1.5 * 1315)
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in got)
