"""Quality rules: line sequence labelling with a linear-chain conditional random
field, decoded by Viterbi; the share of content decides.

Each line with a word is described by a few binary features (symbols, capitals,
separators, repetition, stock phrases, ...). The chain's weights (features by
label, transitions, first line) are learned by gradient ascent on the
conditional likelihood with forward-backward, from at most ``PER_CLASS``
documents of each ``labels.quality``; all lines of a good document count as
content, all of a bad one as boilerplate, weighted by how many documents each
stands for. Viterbi then labels the lines of every whole text. A document stays
when it passes the base rules and at least ``CONTENT_SHARE`` of its word
characters are in content lines.

Base rules: at least 20 words, and at most 30 in 100 words inside 8-word windows
that occur more than once.

Defined results: null and empty texts have no words, fail the base and go; rows
with a null doc_id are judged, not learned from; without labels of both kinds
fixed weights are used; repeated rows get equal results; an empty table gives an
empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread
from .sampling import bounded_sample

PER_CLASS = 1000
#: Lines of a training sequence.
SEGMENT = 512
CONTENT_SHARE = 0.5
MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]")
_STOCK = re.compile(
    r"licen[sc]ed under|all rights reserved|copyright|cookie|privacy policy|terms of (?:use|service)|subscribe|"
    r"sign (?:in|up)|log ?in\b|click here|read more|share (?:this|on)|javascript|newsletter|advertis", re.I)
FEATURES = ("bias", "symbols", "many_symbols", "capitals", "bars", "few_words", "one_word", "repeats_line",
            "repeats_words", "shouts", "digits", "stock", "ends_sentence", "long_words", "first", "last")
N = len(FEATURES)


def line_features(text: str | None) -> tuple[list[list[int]], list[int]]:
    """For each line with a word: numbers of its features, and its word characters."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = [w for w in _BLANKS.split(line) if w]
        if not words:
            continue
        size, n = sum(map(len, words)), len(words)
        symbols = len(_SYMBOLS.findall(line))
        f = [0]
        if symbols > 0.02 * size:
            f.append(1)
        if symbols > 0.1 * size:
            f.append(2)
        if n > 1 and sum(w.upper() == w and w.lower() != w for w in words) > 0.6 * n:
            f.append(3)
        if line.count("|") * 4 >= n:
            f.append(4)
        if n < 4:
            f.append(5)
        if n == 1:
            f.append(6)
        if line in seen:
            f.append(7)
        if n >= 6 and len(set(words)) < 0.4 * n:
            f.append(8)
        if line.count("!!") * 3 > n:
            f.append(9)
        if sum(c.isdigit() for c in line) > 0.3 * size:
            f.append(10)
        if _STOCK.search(line):
            f.append(11)
        if words[-1][-1] in ".!?:;\"')»”…。":
            f.append(12)
        if size > 18 * n:
            f.append(13)
        seen.add(line)
        rows.append(f)
        sizes.append(size)
    if rows:
        rows[0].append(14)
        rows[-1].append(15)
    return rows, sizes


class Chain:
    """Weights of the chain: ``emit`` (features x 2), ``move`` (2 x 2), ``start``
    (2). Label 0 is content, 1 boilerplate."""

    def __init__(self, emit=None, move=None, start=None):
        self.emit = np.zeros((N, 2)) if emit is None else np.asarray(emit, float).reshape(N, 2)
        self.move = np.zeros((2, 2)) if move is None else np.asarray(move, float).reshape(2, 2)
        self.start = np.zeros(2) if start is None else np.asarray(start, float)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in rows]).reshape(len(rows), 2)

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        if not rows:
            return []
        e = self.scores(rows).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + m00 if from_a else b + m10) + x, (a + m01 if from_b else b + m11) + y
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def default_chain() -> Chain:
    c = Chain()
    for name, w in (("bias", -1.0), ("many_symbols", 3.0), ("capitals", 2.0), ("bars", 2.5), ("repeats_line", 2.0),
                    ("repeats_words", 3.0), ("shouts", 2.5), ("stock", 2.5), ("one_word", 0.5), ("ends_sentence", -0.5)):
        c.emit[FEATURES.index(name), 1] = w
    c.move[[0, 1], [0, 1]] = 0.7
    return c


def line_masks(text: str | None) -> np.ndarray:
    """The features of each line as the bits of a number."""
    return np.array([sum(1 << k for k in f) for f in line_features(text)[0]], dtype=np.uint16)


def fit_chain(masks: list[np.ndarray], bad: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.15,
              l2: float = 1e-3) -> Chain:
    """Maximum conditional likelihood with Adam; sequences of line masks, longest first,
    so step t runs over those that still have a line t. Longer documents are cut into
    sequences of ``SEGMENT`` lines, all of which count, so memory grows with the lines, not with
    the longest document, and a round takes ``SEGMENT`` steps at most."""
    # a document counts the same, long or short
    pieces = [(m[k:k + SEGMENT], i, weight[i] / len(m)) for i, m in enumerate(masks) for k in range(0, len(m), SEGMENT)]
    pieces.sort(key=lambda p: -len(p[0]))
    if not pieces:
        return default_chain()
    length = np.array([len(p[0]) for p in pieces])
    y = bad[[p[1] for p in pieces]].astype(int)
    per_line = np.array([p[2] for p in pieces]) / weight[[i for i, m in enumerate(masks) if len(m)]].sum()
    live = [int((length > t).sum()) for t in range(length[0])]
    # the different masks; lines hold numbers of them
    known, number = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
    bits = (known[:, None] >> np.arange(N) & 1).astype(float)
    starts = np.cumsum(length) - length
    x = [number[starts[:n] + t] for t, n in enumerate(live)]
    theta = np.zeros(N * 2 + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((len(known), 2))
    gold_move = np.zeros((2, 2))
    for t, n in enumerate(live):
        np.add.at(gold, (x[t], y[:n]), per_line[:n])
        if t:
            gold_move += np.diag(np.bincount(y[:n], weights=per_line[:n], minlength=2))
    gold_emit = bits.T @ gold
    gold_start = np.array([(per_line * (y == c)).sum() for c in (0, 1)])
    for step in range(1, steps + 1):
        chain = Chain(theta[:2 * N], theta[2 * N:2 * N + 4], theta[2 * N + 4:])
        score = bits @ chain.emit
        forward = [chain.start + score[x[0]]]
        for t in range(1, len(live)):
            p = forward[-1][:live[t], :, None] + chain.move
            forward.append(np.logaddexp(p[:, 0], p[:, 1]) + score[x[t]])
        total = np.empty(len(pieces))
        nxt = np.zeros((0, 2))
        expected, move = np.zeros((len(known), 2)), np.zeros((2, 2))
        for t in range(len(live) - 1, -1, -1):
            n, k = live[t], len(nxt)
            b = np.zeros((n, 2))
            if k:
                onward = chain.move[None] + (score[x[t + 1]] + nxt)[:, None, :]
                b[:k] = np.logaddexp(onward[..., 0], onward[..., 1])
            ended = slice(k, n)
            total[ended] = np.logaddexp(forward[t][ended, 0], forward[t][ended, 1])
            if k:
                both = np.exp(forward[t][:k, :, None] + onward - total[:k, None, None])
                move += np.einsum("n,nij->ij", per_line[:k], both)
            q = per_line[:n, None] * np.exp(forward[t] + b - total[:n, None])
            for c in (0, 1):
                expected[:, c] += np.bincount(x[t], weights=q[:, c], minlength=len(known))
            if t == 0:
                begin = q.sum(axis=0)
            nxt = b
        g = np.concatenate(((gold_emit - bits.T @ expected).ravel(), (gold_move - move).ravel(), gold_start - begin)) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[:2 * N], theta[2 * N:2 * N + 4], theta[2 * N + 4:])


def repeated_words(words: np.ndarray, first: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Per text, the words inside k-word windows that the text has more than once."""
    h, at, of = S.windows(words, first, k)
    order = np.lexsort((h, of))
    h, at, of = h[order], at[order], of[order]
    same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, content_share double, n_lines long")


def _judge(model, share: float):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = model.value
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            n_repeat, n_words = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for a, b in S.batches(texts):
                words, first = S.word_hashes([t.encode("utf-8", "replace") for t in texts[a:b]], S.SPACES)
                n_words[a:b], n_repeat[a:b] = np.diff(first), repeated_words(words, first)
            rows = []
            for i, t in enumerate(texts):
                lines = [x for x in t.split("\n") if _BLANKS.sub("", x)]
                features, sizes = line_features(t)
                labels = chain.viterbi(features)
                total = sum(sizes)
                content = sum(s for s, y in zip(sizes, labels) if y == 0) / total if total else 0.0
                failed = bool(n_words[i] < MIN_WORDS or 100 * n_repeat[i] > MOST_REPEATED * n_words[i])
                rows.append((total, len(_SYMBOLS.findall(t)), len(lines) - len(set(lines)), failed,
                             not failed and content >= share, content, len(lines)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": n_words, "word_chars": cols[0],
                                "n_symbols": cols[1], "n_dup_lines": cols[2], "n_repeat_words": n_repeat,
                                "base_failed": cols[3], "kept": cols[4], "content_share": cols[5], "n_lines": cols[6]})

    return scan


def _masked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.drop(columns="text").assign(masks=[line_masks(t).tobytes() for t in frame["text"]])


def _fit_task(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "quality"])
    bad = frame["quality"].to_numpy() == 0
    n = np.array([max(1, int((~bad).sum())), max(1, int(bad.sum()))])
    weight = frame["group_n"].to_numpy(np.float64) / n[bad.astype(int)]
    c = fit_chain([np.frombuffer(m, dtype=np.uint16) for m in frame["masks"]], bad, weight)
    return pd.DataFrame({"w": [np.concatenate((c.emit.ravel(), c.move.ravel(), c.start))]})


def fitted_chain(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    learn = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(
        "doc_id is not null and quality in (0, 1)")
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    sample = keep(bounded_sample(learn.join(docs.select("doc_id"), "doc_id", "left_semi"), "quality", per_class),
                  "quality-sample")
    if sample.select("quality").distinct().count() < 2:
        return default_chain()
    # two bytes a line go to the one task that fits, not texts
    lines = docs.join(sample, "doc_id").select("doc_id", "quality", "group_n", "text").mapInPandas(
        _masked, "doc_id long, quality int, group_n long, masks binary")
    row = lines.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fit_task, "w array<double>").first()
    w = np.array(row.w)
    return Chain(w[:2 * N], w[2 * N:2 * N + 4], w[2 * N + 4:])


def judge_quality(documents: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE,
                  per_class: int = PER_CLASS) -> DataFrame:
    """One row per document, as in ``OUT``."""
    model = documents.sparkSession.sparkContext.broadcast(fitted_chain(documents, labels, per_class))
    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInPandas(_judge(model, share), OUT)
