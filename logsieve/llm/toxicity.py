"""Toxicity by weak supervision: many lexicon and pattern voters, a generative
label model over their votes, and a linear classifier fitted to its posteriors.

1. *Voters.* From a bounded labelled sample the lexicon voters are induced: words
   and word beginnings (4 to 8 bytes), occurring once, twice or three times, whose
   share of toxic documents is far above their share of others. A seed lexicon of
   insults and a few patterns (threats, shouting, second-person attacks) vote too,
   and one voter says "clean" where no lexicon entry occurs. A voter abstains where
   it has nothing to say.
2. *Label model.* Expectation-maximisation estimates how often each voter speaks
   in toxic and in clean documents (the given label is one more voter, of known accuracy).
   Voters that repeat each other given the label (their correlation under the
   posterior) share their weight, so ten spellings of one word don't count ten
   times. The class share is that of all labelled rows.
3. *Classifier.* A logistic regression on the voters' evidence and on lexicon
   counts and rates is fitted to the posteriors; it never sees labels, lang,
   source or ids.

Voters are induced from counts that Spark sums over the sample (at most
``PER_CLASS`` documents of each label); the one task that fits gets the sample's
features, no texts. Scoring is one pass over the whole texts with a small broadcast
model.

Defined results: null and empty texts get the score of a text without evidence;
rows with a null doc_id are scored, not learned from; with no labels (or of one
kind only) the seed lexicon alone decides; several labels of a document each
count; repeated rows get equal scores; empty tables give an empty result; other
columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread
from .sampling import bounded_sample, remainder

PER_CLASS = 2500
FOLDS, HELD = 5, 0
MOST_VOTERS = 400
# Bytes and texts looked at together.
BATCH, BATCH_TEXTS = 1 << 18, 1000
LEVELS = (1, 2, 3)
# How often a given label says "toxic" in toxic and in clean documents.
TRUST = (0.97, 0.005)
PREFIXES = (4, 5, 6, 7, 8)

SEED_LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "trash", "scum", "pathetic",
    "worthless", "disgusting", "clown", "garbage", "imbecile", "retard", "bastard", "bitch", "asshole", "whore",
    "slut", "faggot", "cunt", "fuck", "fucking", "shit", "vermin", "filth", "subhuman",
)
PATTERNS = (
    r"\b(?:you|u|ur|your|you're)\s+(?:\w+\s+){0,3}(?:idiot|moron|stupid|loser|trash|scum|clown|pathetic|worthless)",
    r"\b(?:kill|hang|hurt)\s+(?:yourself|them all|you)\b",
    r"\b(?:shut up|go to hell|drop dead)\b",
    r"(?:[A-Z]{3,}!{1,}\s*){6,}",
)
RATES = 4  # features after the votes
_COMPILED = [re.compile(p, re.I if i < 3 else 0) for i, p in enumerate(PATTERNS)]
_U = np.uint64


def evidence(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of every word and word beginning, and the words of
    each text. Words are lower-cased runs of letters, digits, non-ASCII."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in raw])
    in_word = ~S.PUNCTUATION[joined]
    in_word[ends_of - 1] = False
    edge = np.diff(in_word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(joined)
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    np.cumsum((joined.astype(_U) + _U(1)) * S._powers(S._R, n), out=sums[1:])
    back = S._powers(S._R_INV, n)[starts]
    doc = np.searchsorted(ends_of, starts, side="right")
    out, of = [S.mixed((sums[ends] - sums[starts]) * back)], [doc]
    for p in PREFIXES:
        longer = ends - starts > p
        at = starts[longer]
        out.append(S.mixed((sums[at + p] - sums[at]) * back[longer] + _U(p)))
        of.append(doc[longer])
    return np.concatenate(out), np.concatenate(of), np.bincount(doc, minlength=len(texts))


def seed_hashes() -> np.ndarray:
    return np.unique([evidence([w])[0][0] for w in SEED_LEXICON])


def _counts(hashes: np.ndarray, of: np.ndarray):
    order = np.lexsort((hashes, of))
    h, d = hashes[order], of[order]
    if not len(h):
        return d, h, np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    return d[first], h[first], np.diff(np.concatenate((first, [len(h)])))


class Features:
    """Votes and features of texts, for a chosen lexicon (sorted hashes)."""

    def __init__(self, lexicon: np.ndarray, levels: list[tuple[int, int]]):
        self.lexicon, self.seeds = lexicon, seed_hashes()
        self.levels = levels  # voters: (number in the lexicon, at least so often)
        # a small table finds the few hashes worth a search
        self.known = np.unique(np.concatenate((lexicon, self.seeds)))
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self.known >> _U(44)] = True

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(votes: texts x voters, 0 or 1; features: texts x n)."""
        h, of, words = evidence(texts)
        near = self.table[h >> _U(44)]
        h, of = h[near], of[near]
        n, k = len(texts), len(self.lexicon)
        counts = np.zeros((n, k + 1))
        if k:
            at = np.minimum(np.searchsorted(self.lexicon, h), k - 1)
            hit = self.lexicon[at] == h
            np.add.at(counts, (of[hit], at[hit]), 1)
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        seeded = np.bincount(of[self.seeds[at] == h], minlength=n)
        votes = [counts[:, i] >= level for i, level in self.levels]
        found = [np.array([bool(p.search(t)) if t else False for t in texts]) for p in _COMPILED]
        lexical = counts[:, :k].sum(axis=1)
        clean = (lexical + seeded) == 0
        votes = np.column_stack([*votes, seeded >= 1, seeded >= 2, *found, clean]).astype(np.float64)
        rates = np.column_stack([np.log1p(lexical), np.log1p(seeded), 20 * lexical / np.maximum(words, 20),
                                 20 * seeded / np.maximum(words, 20)])
        return votes, np.column_stack([votes, rates])


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word or beginning of a batch: the toxic and the other texts that have
    it once, twice, three times."""
    for frame in frames:
        texts, labels = frame["text"].tolist(), frame["toxic"].to_numpy(np.int64)
        for a, b in S.batches(texts, BATCH, BATCH_TEXTS):
            d, h, c = _counts(*evidence(texts[a:b])[:2])
            names, number = np.unique(h, return_inverse=True)
            toxic, found = labels[a:b][d] == 1, {"hash": names.view(np.int64)}
            for level in LEVELS:
                for kind, own in (("a", toxic), ("b", ~toxic)):
                    found[f"{kind}{level}"] = np.bincount(number[(c >= level) & own], minlength=len(names))
            yield pd.DataFrame(found)


def induce(texts: DataFrame, n1: int, n0: int, most: int = MOST_VOTERS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Lexicon and its voters, best first, by the z-score of the toxic share among the
    n1 toxic and n0 other rows of ``texts``."""
    kinds = [f"{kind}{level}" for level in LEVELS for kind in "ab"]
    counts = texts.select("text", "toxic").mapInPandas(
        _word_counts, "hash long, " + ", ".join(f"{k} long" for k in kinds))
    rates = ", ".join(f"{level}, a{level}, b{level}" for level in LEVELS)
    voters = counts.groupBy("hash").agg(*[F.sum(k).alias(k) for k in kinds]).selectExpr(
        "hash", f"stack({len(LEVELS)}, {rates}) as (level, a, b)").filter(F.col("a") >= max(4, n1 * 0.004))
    a, b = F.col("a"), F.col("b")
    p1, p0 = (a + F.lit(0.5)) / F.lit(n1 + 1.0), (b + F.lit(0.5)) / F.lit(n0 + 1.0)
    both = (a + b + F.lit(1.0)) / F.lit(n1 + n0 + 2.0)
    z = (p1 - p0) / F.sqrt(both * (F.lit(1.0) - both) * F.lit(1 / n1 + 1 / n0))
    found = (voters.select("hash", "level", z.alias("z"), (p1 > F.lit(4.0) * p0).alias("far")).filter("z > 5 and far")
             .orderBy(F.desc("z"), F.col("hash") < 0, "hash", "level").limit(most).collect())  # hashes have no sign
    lexicon = np.unique(np.array([r.hash for r in found], dtype=np.int64).view(_U))
    place = {int(h): k for k, h in enumerate(lexicon.view(np.int64))}
    return lexicon, [(place[r.hash], r.level) for r in found]


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, share: float,
                rounds: int = 15) -> np.ndarray:
    """Posterior of "toxic" for each row from the votes and the given label."""
    v = votes
    trusted = np.where(given > 0.5, np.log(TRUST[0] / TRUST[1]), np.log((1 - TRUST[0]) / (1 - TRUST[1])))
    q = np.clip(given, 0.05, 0.95)
    for _ in range(rounds):
        w1, w0 = weight * q, weight * (1 - q)
        rate1 = (w1 @ v + 0.5) / (w1.sum() + 1.0)
        rate0 = (w0 @ v + 0.05) / (w0.sum() + 1.0)
        # what two voters still share once the label is known
        left = v - np.outer(q, rate1)
        left -= np.outer(1 - q, rate0)
        left *= np.sqrt(weight)[:, None]
        size = np.sqrt((left * left).sum(axis=0)) + 1e-9
        together = np.clip((left.T @ left) / np.outer(size, size), 0.0, 1.0)
        np.fill_diagonal(together, 0.0)
        together[together < 0.1] = 0.0
        worth = 1.0 / (1.0 + together.sum(axis=1))
        says = np.log(rate1 / rate0)
        score = np.log(share / (1 - share)) + trusted + v @ (worth * says)  # an abstention says nothing
        new = 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))
        done, q = np.abs(new - q).max() < 1e-4, new
        if done:
            break
    return q


def fit_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-4,
                   steps: int = 400) -> np.ndarray:
    """Weights and bias (last) of a logistic regression, by accelerated gradient."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.sum()
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 0.0
    rate = 1.0 / (0.25 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + l2)
    w = np.zeros(x.shape[1])
    y, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ y, -30, 30)))
        new = y - rate * (x.T @ (weight * (p - target)) + penalty * y)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def _featured(voters):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(*voters.value)
        for frame in frames:
            texts, rows = frame["text"].tolist(), frame.drop(columns="text")
            for a, b in S.batches(texts, BATCH, BATCH_TEXTS):
                yield rows.iloc[a:b].assign(x=list(features(texts[a:b])[1]))

    return scan


def _fit_task(share_toxic: float):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "toxic"])
        x, labels = np.stack(frame["x"].tolist()), frame["toxic"].to_numpy(np.int64)
        # classes are sampled apart: rows count as many as they stand for
        weight = frame["group_n"].to_numpy(np.float64) / np.bincount(labels, minlength=2)[labels]
        share = min(max(share_toxic, 1e-3), 0.999)
        q = label_model(x[:, :-RATES], labels.astype(np.float64), weight, share)
        return pd.DataFrame({"w": [fit_classifier(x, q, weight)]})

    return task


def default_model() -> tuple[np.ndarray, list, np.ndarray]:
    """Without labels: seed lexicon and patterns, equally trusted."""
    n = 2 + len(PATTERNS) + 1 + RATES
    w = np.zeros(n + 1)
    w[:2 + len(PATTERNS)], w[-1] = 3.0, -2.0
    return np.empty(0, dtype=_U), [], w


def _score(model):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, levels, w = model.value
        features = Features(lexicon, levels)
        for frame in frames:
            texts, score = frame["text"].tolist(), np.zeros(len(frame))
            for a, b in S.batches(texts, BATCH, BATCH_TEXTS):
                _, x = features(texts[a:b])
                score[a:b] = 1.0 / (1.0 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield frame.drop(columns="text").assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    return scan


def fitted_model(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple:
    """(lexicon, voters, weights) from the labels that may be learned from."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    learn = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(
        "doc_id is not null and toxic in (0, 1)").filter(remainder(F.col("doc_id"), FOLDS) != HELD)
    sample = keep(bounded_sample(learn.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic", per_class),
                  "toxicity-sample")
    sizes = {r.toxic: r.group_n for r in sample.groupBy("toxic").agg(F.first("group_n").alias("group_n")).collect()}
    if len(sizes) == 2:
        share = sizes[1] / (sizes[0] + sizes[1])
        texts = keep(docs.join(sample, "doc_id"), "toxicity-texts")
        n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
        texts = spread(texts)
        lexicon, levels = induce(texts, n[1], n[0])
        voters = documents.sparkSession.sparkContext.broadcast((lexicon, levels))
        rows = texts.mapInPandas(_featured(voters), "doc_id long, toxic int, group_n long, x array<double>")
        fitted = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fit_task(share), "w array<double>")
        return lexicon, levels, np.array(fitted.first().w)
    return default_model()


def score_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = documents.sparkSession.sparkContext.broadcast(fitted_model(documents, labels, per_class))
    out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return spread(documents.select(F.col("doc_id").cast("long"), "text", out.alias("held_out"))).mapInPandas(
        _score(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``documents``, all columns, that are not predicted toxic."""
    model = documents.sparkSession.sparkContext.broadcast(fitted_model(documents, labels, per_class))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, levels, w = model.value
        features = Features(lexicon, levels)
        for batch in batches:
            texts, clean = batch.column("text").to_pylist(), np.ones(batch.num_rows, dtype=bool)
            for a, b in S.batches(texts, BATCH, BATCH_TEXTS):
                clean[a:b] = features(texts[a:b])[1] @ w[:-1] + w[-1] < 0
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(scan, documents.schema)
