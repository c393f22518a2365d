"""Token alignment against plain loops with the vocabularies' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from logsieve.llm import token_align as T


def brute(rows, folder=T.TOKENIZERS):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{T.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{T.PIECES}")
    letters = T.byte_letters()
    docs, count = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ends = ([], [])
        joined = []
        for k, ids in enumerate((x, y)):
            data = b""
            for i in ids:
                if k == 0:
                    data += bytes(letters[c] for c in a.id_to_token(i))
                else:
                    data += bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(
                        i).replace("▁", " ").encode()
                ends[k].append(len(data))
            joined.append(data)
        if not text or not joined[0] == joined[1] == (" " + text).encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        links = Counter()
        j = 0
        for i, e in enumerate(ends[0]):
            lo = ends[0][i - 1] if i else 0
            while ends[1][j] <= lo:
                j += 1
            k = j
            while k < len(y) and (ends[1][k - 1] if k else 0) < e:
                links[x[i], y[k]] += 1
                k += 1
        groups, ga, gb, i, k = [], [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            ga, gb = [], []
            while i < len(x) and ends[0][i] <= cut:
                ga.append(x[i])
                i += 1
            while k < len(y) and ends[1][k] <= cut:
                gb.append(y[k])
                k += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        for p in links:
            count[p] += 1
        docs.append((doc_id, x, y, links, groups))
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for doc_id, x, y, links, groups in docs:
        links = links or Counter()
        out.append((doc_id, len(x), len(y), len(groups), sum(links.values()),
                    sum(m for p, m in links.items() if count[p] == best[p[0]]),
                    sum(m * count[p] for p, m in links.items()),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(2)
    words = ["the", "naïve", "Straße", "日本語", "x" * 30, "<|endoftext|>", "</s>", "12345", "don't", "▁", "🙂", "a"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " "), (103, "two  spaces\tand\nlines "), (104, "a" * 20_000),
                   (105, " nbsp　wide ﬁligature"), (3, "again"), (3, "again"), (None, "no id"),
                   (106, "the " * 20_000), (107, "\x00null"), (108, " leading")]


@pytest.mark.parametrize("records,parts,fan", [(1 << 20, 64, 256), (300, 3, 2)])
def test_alignment(docs, records, parts, fan):
    rows = corpus()
    found = T.align_documents(docs(rows).repartition(6), records=records, parts=parts, fan=fan).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_empty(docs):
    assert T.align_documents(docs([])).count() == 0
    assert [tuple(r) for r in T.align_documents(docs([(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_both_encoders_agree():
    """By rank and by the file's own library: the same ids, over many scripts."""
    a = T.loaded(T.TOKENIZERS)[0]
    assert a.fast is not None
    rnd = random.Random(4)
    pool = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" " + "".join(rnd.choice(pool) + rnd.choice(["", " ", "a", "1", "\n", "'s", "  "]) for _ in range(200))
             for _ in range(300)]
    assert [list(x) for x in a.encode(texts)] == [a.slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs():
    rnd = np.random.default_rng(0)
    every = Counter()
    blobs = []
    for _ in range(9):
        pairs = np.unique(rnd.integers(0, 40_000, rnd.integers(1, 30_000)))
        counts = rnd.integers(1, 1 << 40, len(pairs))
        blobs.append(T.pack_run(pairs, counts))
        for p, c in zip(pairs.tolist(), counts.tolist()):
            every[p] += c
    pairs, counts = T.whole_run(T.merge_runs(blobs))
    assert dict(zip(pairs.tolist(), counts.tolist())) == dict(every) and (np.diff(pairs) > 0).all()
    marks = T.totals(np.array([1, 2, 11, 12]), np.array([5, 5, 1, 7]), 10)
    assert marks.tolist() == [11, 11, 2, 15]
