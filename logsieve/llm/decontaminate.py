"""Benchmark decontamination: size-partitioned MinHash containment search.

Which documents hold (almost) all five-word shingles of a benchmark item? A
signature of the whole document would not show a short item inside a long text,
so only the items are sketched. Items are partitioned by their number of
shingles (powers of two). An item's sketch is its ``width`` smallest shingle
hashes, all of them in the small partitions; a document that holds a share t of
an item's shingles holds, whatever its own length, about a share t of the
sketch. Each partition has its own least number of hits, the largest with a
miss probability under ``MISS`` for an item that is contained at the threshold.
Documents are read once; the (few) that hit a sketch are kept with their hits,
joined with the sketches, and the candidates verified by exact shingle sets.

The sketches go to the tasks as one sorted array while they have at most
``BROADCAST_ROWS`` rows (the size is counted first); beyond that all shingles of
the documents are joined with the sketch table, with the same result.

Words are lower-cased runs of letters, digits and non-ASCII characters. An item
of one to four words has one shingle, all its words. Defined results: null and
empty texts and items without words match nothing; repeated documents and items
give a row each (rows of one item_id and text count once); empty tables give an
empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread

THRESHOLD = 0.8
WIDTH = 16
MISS = 1e-6
BROADCAST_ROWS = 1 << 20

PAIRS = "doc_id long, item_id long, n_shingles int, n_found int, containment double"


def least_hits(width: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The largest h with P(Binomial(width, threshold) < h) <= miss, 1 at least."""
    below, h = 0.0, 0
    while h < width:
        below += math.comb(width, h) * threshold**h * (1 - threshold) ** (width - h)
        if below > miss:
            break
        h += 1
    return max(1, h)


def _prepared(text) -> bytes:
    return text.lower().encode("utf-8", "replace") if text else b""


def _hashes(texts: list, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the shingles of the given sizes; each size is
    hashed apart."""
    words, first = S.word_hashes([_prepared(t) for t in texts], S.PUNCTUATION)
    found = [S.shingle_hashes(words, first, k, short=False) for k in sizes]
    return (np.concatenate([S.mixed(h + np.uint64(k)) for (h, _), k in zip(found, sizes)]),
            np.concatenate([of for _, of in found]))


def item_sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, text, k (words in a shingle), n_shingles, part, need (least
    hits), sketch (array of hashes)."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"]):
                n_words = len(S.word_hashes([_prepared(text)], S.PUNCTUATION)[0])
                if n_words:
                    k = min(S.SHINGLE, n_words)
                    own = np.unique(_hashes([text], [k])[0])
                    part = int(math.log2(len(own)))
                    # small partitions are taken whole
                    used = len(own) if 2 ** (part + 1) <= 2 * width else width
                    used = min(used, len(own))
                    rows.append((item, text, k, len(own), part, least_hits(used, threshold),
                                 own[:used].view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "text", "k", "n_shingles", "part", "need", "sketch"])

    return (items.select(F.col("item_id").cast("long"), "text").distinct()
            .mapInPandas(sketch, "item_id long, text string, k int, n_shingles int, part int, need int, sketch array<long>"))


def _hits(known, sizes: list[int]):
    """Documents with a shingle in ``known`` (a broadcast sorted array), and those
    shingles; with None, all shingles of all documents."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = known.value if known is not None else None
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in S.batches(texts):
                h, of = _hashes(texts[a:b], sizes)
                if table is not None:
                    at = np.searchsorted(table, h)
                    at[at == len(table)] = 0
                    hit = table[at] == h if len(table) else np.zeros(len(h), dtype=bool)
                    h, of = h[hit], of[hit]
                rows = []
                order = np.argsort(of, kind="stable")
                h, of = h[order], of[order]
                docs, starts = np.unique(of, return_index=True)
                for d, own in zip(docs, np.split(h, starts[1:])):
                    rows.append((frame["doc_id"].iloc[a + d], texts[a + d], np.unique(own).view(np.int64)))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "text", "hits"])

    return scan


def _verify(threshold: float):
    def shingle_set(words: list[bytes], k: int) -> set:
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}

    table = bytes(32 if S.PUNCTUATION[b] else b for b in range(256))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, found in zip(frame["doc_id"], frame["text"], frame["items"]):
                words, sets = _prepared(text).translate(table).split(), {}
                for item in found:
                    k = item["k"]
                    if k not in sets:
                        sets[k] = shingle_set(words, k)
                    own = shingle_set(_prepared(item["text"]).translate(table).split(), k)
                    n = len(own & sets[k])
                    if n >= threshold * len(own):
                        rows.append((doc, item["item_id"], len(own), n, n / len(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shingles", "n_found", "containment"])

    return exact


def contained_items(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold``
    of the shingles: doc_id, item_id, n_shingles, n_found, containment."""
    spark = documents.sparkSession
    sketches = keep(item_sketches(items, width, threshold), "sketches")
    sizes = sorted(r.k for r in sketches.select("k").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], PAIRS)
    entries = sketches.select("item_id", "need", F.xxhash64("text").alias("text_key"), F.explode("sketch").alias("h"))
    distinct = entries.select("h").distinct()
    known = None
    if distinct.count() <= broadcast_rows:
        rows = distinct.toPandas()["h"].to_numpy(np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(rows))
    scanned = spread(documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null")).mapInPandas(
        _hits(known, sizes), "doc_id long, text string, hits array<long>")
    hit = keep(scanned.withColumn("row", F.monotonically_increasing_id()), "hits")
    candidates = (hit.select("row", F.explode("hits").alias("h")).join(entries, "h")
                  .groupBy("row", "item_id", "text_key").agg(F.count("*").alias("n"), F.first("need").alias("need"))
                  .filter("n >= need"))
    told = sketches.select("item_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("item_text"), "k")
    lists = (candidates.join(told, ["item_id", "text_key"]).groupBy("row").agg(
        F.collect_list(F.struct("item_id", F.col("item_text").alias("text"), "k")).alias("items")))
    return hit.select("row", "doc_id", "text").join(lists, "row").select(
        "doc_id", "text", "items").mapInPandas(_verify(threshold), PAIRS)


def drop_contaminated(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, all columns, that contain no item. Rows with a
    null doc_id can't be named by a pair and stay."""
    return documents.join(contained_items(documents, items, **options).select("doc_id").distinct(), "doc_id", "left_anti")
