"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal)
and elastic-net penalties, then calibrated with a temperature.

Inverse document frequencies are counted over all rows that may be learned from.
The classifier is fitted, in one task, on at most ``PER_LANG`` of them for each
language (a quarter of those set the temperature). The model is a table of
``WIDTH`` x languages numbers, whatever the corpus; every text is scored whole.

Features are hashed 1- to 3-grams of lower-cased letters, any run of other
characters counting as one space mark each. A feature's value is its share of the
text's n-grams times its inverse document frequency.

Defined results: null texts and texts without a letter are ``und`` with score 0,
and so is every text when there is nothing to learn from; rows with a null
doc_id are scored, not learned from; repeated rows get equal results; an empty
table gives an empty result; other columns of the input are ignored.
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
from .sampling import bounded_sample, remainder

PER_LANG = 300
FOLDS, HELD = 4, 2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
SCALE = 100.0

_CHARS, _PAIRS, _TRIPLES = 1 << 8, 1 << 13, 1 << 15
WIDTH = _CHARS + _PAIRS + _TRIPLES
_LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(feature number of every n-gram of the texts, start of each text): texts
    are taken one after another, each with a space before and after."""
    joined = " ".join(["", *[(t or "").lower() for t in texts], ""])
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    other = (c < 128) & ~((c >= 97) & (c <= 122)) | (c >= 0x80) & (c < 0xC0) | (c >= 0x2000) & (c < 0x2070)
    c = np.where(other, np.uint32(0), (c * np.uint32(0x9E3779B1)) >> np.uint32(24) | np.uint32(1))
    lengths = np.array([len((t or "").lower()) + 1 for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    n = int(starts[-1])
    c = np.concatenate((c[:n + 2], np.zeros(max(0, n + 2 - len(c)), dtype=np.uint32)))
    a, b, d = c[:n], c[1:n + 1], c[2:n + 2]
    two = a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35)
    three = (two ^ (two >> np.uint32(13))) * np.uint32(0x27D4EB2F) + d * np.uint32(0x165667B1)
    out = np.empty((n, 3), dtype=np.int32)
    out[:, 0] = a
    out[:, 1] = _CHARS + (two >> np.uint32(32 - 13))
    out[:, 2] = _CHARS + _PAIRS + ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 15))
    return out, starts


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, texts of this task that have it); feature -1: the texts."""
    total, n = np.zeros(WIDTH, dtype=np.int64), 0
    for frame in frames:
        texts = frame["text"].tolist()
        for a, b in S.batches(texts, 1 << 20):
            g, starts = grams(texts[a:b])
            for i in range(0, b - a, 64):
                j = min(i + 64, b - a)
                has = np.zeros((j - i) * WIDTH, dtype=np.uint8)
                row = np.repeat(np.arange(j - i, dtype=np.int64) * WIDTH, np.diff(starts[i:j + 1]))
                part = g[starts[i]:starts[j]]
                for k in range(3):
                    has[row + part[:, k]] = 1
                total += has.reshape(j - i, WIDTH).sum(axis=0, dtype=np.int64)
            n += b - a
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"feature": np.concatenate((seen, [-1])), "n": np.concatenate((total[seen], [n]))})


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    rows = texts.mapInPandas(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counts, n = np.zeros(WIDTH), 0
    for r in rows.collect():  # at most WIDTH + 1 rows
        if r.feature < 0:
            n = r.n
        else:
            counts[r.feature] = r.n
    return np.log((1.0 + n) / (1.0 + counts)) + 0.05


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list, langs: list, idf: np.ndarray, seed: int = 3) -> tuple[list, np.ndarray, np.ndarray, float]:
    """(languages, weights WIDTH x languages, bias, temperature)."""
    names = sorted(set(langs))
    target = np.searchsorted(names, langs)
    rows = []
    for t in texts:
        f, n = np.unique(grams([t])[0], return_counts=True)
        rows.append((f, n / n.sum() * idf[f] * SCALE))
    order = np.random.default_rng(seed).permutation(len(rows))
    check = order[:len(rows) // 4]
    train = order[len(rows) // 4:] if len(rows) > 8 else order
    k = len(names)
    z, n2 = np.zeros((WIDTH + 1, k)), np.zeros((WIDTH + 1, k))

    def weights(f):
        zf, nf = z[f], n2[f]
        w = -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2)
        return np.where(np.abs(zf) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i in train:
            f = np.append(rows[i][0], WIDTH)
            x = np.append(rows[i][1], 1.0)
            w = weights(f)
            p = _softmax(x @ w)
            p[target[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n2[f] + g * g) - np.sqrt(n2[f])) / ALPHA
            z[f] += g - sigma * w
            n2[f] += g * g
    w = weights(np.arange(WIDTH + 1))
    logits = np.array([rows[i][1] @ w[rows[i][0]] + w[WIDTH] for i in check]).reshape(-1, k)
    best, temperature = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.05), np.log(20.0), 121)):
        p = _softmax(logits / t)[np.arange(len(check)), target[check]]
        loss = -np.log(np.maximum(p, 1e-12)).mean() if len(check) else 0.0
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    return names, w[:WIDTH], w[WIDTH], temperature


def _fit_task(known):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "lang"])
        names, w, bias, t = fit(frame["text"].tolist(), frame["lang"].tolist(), known.value)
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        features = np.concatenate((used, [WIDTH])).astype(np.int32)
        table = np.concatenate((w[used], bias[None]))
        return pd.DataFrame({"feature": features, "weights": list(table), "names": [names] * len(features),
                             "temperature": t})

    return task


def _predict(model):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, table, bias, temperature = model.value
        for frame in frames:
            texts = frame["text"].tolist()
            best, score = np.empty(len(texts), dtype=object), np.zeros(len(texts))
            for a, b in S.batches(texts, 1 << 20):
                g, starts = grams(texts[a:b])
                sums = sum(np.add.reduceat(table[g[:, k]], starts[:-1], axis=0) for k in range(3))
                logits = sums / (3.0 * np.diff(starts)[:, None]) * SCALE + bias
                p = _softmax(logits / temperature)
                best[a:b] = [names[i] for i in p.argmax(axis=1)]
                score[a:b] = p.max(axis=1)
            for i, t in enumerate(texts):
                if not t or not _LETTER.search(t):
                    best[i], score[i] = "und", 0.0
            yield frame.drop(columns="text").assign(lang_pred=best, score=score)

    return scan


def identify_languages(documents: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = documents.sparkSession
    out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    docs = documents.select(F.col("doc_id").cast("long"), "text", "lang", out.alias("held_out"))
    learn = docs.filter("not held_out and doc_id is not null and lang is not null and text is not null")
    # written first: its size is known then, and the texts need no shuffle to meet it
    sample = keep(bounded_sample(learn.select("doc_id", "lang"), "lang", per_lang)
                  .select("doc_id", "lang").distinct(), "langid-ids")
    rows = keep(learn.join(sample, ["doc_id", "lang"]).select("doc_id", "lang", "text"), "langid-sample")
    scored = spread(docs.select("doc_id", "held_out", "text"))
    if rows.isEmpty():
        return scored.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    known = spark.sparkContext.broadcast(inverse_frequencies(spread(learn.select("text"))))
    learned = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        _fit_task(known), "feature int, weights array<double>, names array<string>, temperature double").collect()
    names = list(learned[0].names)
    table, bias = np.zeros((WIDTH, len(names)), dtype=np.float32), np.zeros(len(names))
    for r in learned:
        if r.feature == WIDTH:
            bias = np.array(r.weights)
        else:
            table[r.feature] = np.array(r.weights) * known.value[r.feature]
    model = spark.sparkContext.broadcast((names, table, bias, learned[0].temperature))
    return scored.mapInPandas(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
