"""Near-duplicate documents by BagMinHash on the multiset of word shingles.

1. *Bags.* A document's bag holds its five-word shingles with multiplicities. A
   sum of scrambled shingle hashes identifies a bag; documents with equal bags
   collapse to one representative (partial aggregation takes hot copies).
2. *Signatures.* Weights are the multiplicities, discretised in unit levels. The
   levels form dyadic blocks [0,1) [1,2) [2,4) [4,8) ...; each (shingle, block)
   carries a Poisson process whose rate is the block's width, and each of its
   points falls on one of ``m`` signature places and on one level of the block;
   a point above the shingle's weight is skipped. So an element of weight w costs
   O(log w) processes, not w. A place keeps its earliest point: two bags agree
   there with probability sum min / sum max, the weighted Jaccard similarity.
   Points are drawn in order of time and only until every place is taken, about
   m log m points a document.
3. *Bands* of the signature give buckets. Within a bucket every member whose size allows
   it meets the least member, the hub: a star, not all pairs, and gets its exact
   similarity to it. A hub's pairs are dealt over at most ``RUNS`` runs; a run gets the
   hub's bag once and streams its members past it. Members that are in one component after that need no more comparison. In
   the buckets that still hold several components two members x and y can only be
   near when their distances to the hub differ by at most 1 - 0.8, as 1 minus the
   weighted Jaccard similarity is a metric (a member that did not meet the hub has no
   distance and is not ruled out by it); for most chance collisions that says
   no. Where at most ``SMALL`` members are outside a bucket's largest component,
   they meet the others directly (a row has at most ``SMALL`` partners); larger
   buckets are cut into blocks, and pairs of blocks are compared inside a task
   that returns only links. No candidate of a bucket is left out.
4. *Verification* is the exact multiset overlap, sum min / sum max >= 0.8.
5. Links make connected components; a class is named by its least doc_id.

Words are as in ``[^\\x20\\x09-\\x0D]+``. A text of one to four words has one
shingle, all its words. Defined results: null, empty and word-free texts are each
a class of their own; repeated rows share a class; the rows of an id with several texts are
judged text by text; a null doc_id joins the class of an equal bag that has an id, and is
compared no further (its class_id is null otherwise); an empty table gives an empty
result; other columns of the input are ignored. Bags in transit keep 48 bits of a
shingle's hash. A pair at exactly 0.8 meets in a
band with probability 0.9995, a closer one more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread
from .components import components

THRESHOLD = 0.8
BANDS, ROWS = 25, 6
SMALL = 24
BLOCK = 256
RUNS = 32

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _salt(k: int) -> np.uint64:
    return _U(k * 0x9E3779B97F4A7C15 % (1 << 64))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def count_bags(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, multiplicity), sorted by both."""
    order = np.lexsort((hashes, of))
    h, d = hashes[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else [])
    return d[first], h[first], np.diff(np.concatenate((first, [len(h)])))


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m float32 signatures; a bag without items keeps infinities."""
    sig = np.full(n_docs * m, np.inf)
    # dyadic blocks below the weight
    of, seed, low, width = [doc], [S.mixed(item)], [np.zeros(len(doc), np.int64)], [np.ones(len(doc), np.int64)]
    top = [weight]
    start, size, block = 1, 1, 1
    while len(weight) and start < weight.max():
        more = np.flatnonzero(weight > start)
        of.append(doc[more])
        seed.append(S.mixed(item[more] + _salt(block)))
        low.append(np.full(len(more), start))
        width.append(np.full(len(more), size))
        top.append(weight[more])
        start, size, block = start + size, size * 2, block + 1
    of, seed, low, width, top = map(np.concatenate, (of, seed, low, width, top))
    rate = np.bincount(of, weights=width, minlength=n_docs)
    horizon = m * (np.log(m) + 4.0) / np.maximum(rate, 1.0)
    time, draws = np.zeros(len(of)), np.zeros(len(of), dtype=np.uint64)
    waiting = np.ones(len(of), dtype=bool)  # the next point is not yet placed
    # first points of all processes
    time = -np.log(_unit(S.mixed(seed + _GOLDEN))) / width
    live = np.arange(len(of))
    while len(live):
        now = live[time[live] <= horizon[of[live]]]
        while len(now):
            bits = S.mixed(seed[now] + (draws[now] * _U(2) + _U(2)) * _GOLDEN)
            place = (bits & _U(0xFFFFFFFF)) % _U(m)
            level = low[now] + ((bits >> _U(32)).astype(np.int64) % width[now])
            fits = level < top[now]
            np.minimum.at(sig, of[now[fits]] * m + place[fits].astype(np.int64), time[now[fits]])
            draws[now] += _U(1)
            time[now] += -np.log(_unit(S.mixed(seed[now] + (draws[now] * _U(2) + _U(1)) * _GOLDEN))) / width[now]
            now = now[time[now] <= horizon[of[now]]]
        # texts with an empty place go on to a later time
        open_ = np.isinf(sig.reshape(n_docs, m)).any(axis=1)
        horizon = np.where(open_, horizon * 1.5, -1.0)
        live = live[open_[of[live]]]
    return sig.reshape(n_docs, m).astype(np.float32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(sig), bands)).copy()
    for j in range(rows):
        key = S.mixed(key + bits[:, :, j])
    return key.view(np.int64)


def bag_sums(h: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """Two sums of scrambled shingle hashes of each of n texts: they name its bag."""
    sums = []
    for salt in (1, 2):
        total = np.zeros(n, dtype=np.uint64)
        np.add.at(total, of, S.mixed(h + _salt(salt)))
        sums.append(total.view(np.int64))
    return sums


def _bag_rows(bands: int, rows: int):
    """doc_id, a hash of the text, the bag's two sums, its size, and the band keys (null
    where the same task has given them for an equal bag)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in S.batches(texts):
                part = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
                h, of = S.shingle_hashes(*S.word_hashes(part, S.SPACES))
                n = b - a
                size = np.bincount(of, minlength=n)
                sums = bag_sums(h, of, n)
                new = []
                for i, key in enumerate(zip(sums[0].tolist(), sums[1].tolist(), size.tolist())):
                    if key[2] and key not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen[key] = True
                        new.append(i)
                new = np.array(new, dtype=np.int64)
                keys = [None] * n
                if len(new):
                    number = np.full(n, -1)
                    number[new] = np.arange(len(new))
                    d, x, w = count_bags(h[number[of] >= 0], number[of][number[of] >= 0])
                    for i, k in zip(new, band_keys(signatures(d, x, w, len(new), bands * rows), bands, rows)):
                        keys[i] = k
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "text_hash": frame["text_hash"].iloc[a:b].to_numpy(),
                                    "b1": sums[0], "b2": sums[1], "size": size, "bands": keys})

    return scan


def pack_bag(items: np.ndarray, counts: np.ndarray) -> bytes:
    """Width of the counts in bytes (0: all are 1), sorted 48-bit items, counts."""
    width = 0 if not (counts > 1).any() else next(w for w in (1, 2, 4) if counts.max() < 1 << 8 * w)
    body = items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return bytes([width]) + body + (counts.astype(f"<u{width}").tobytes() if width else b"")


def unpack_bag(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = blob[0]
    n = (len(blob) - 1) // (6 + width)
    items = np.zeros((n, 8), dtype=np.uint8)
    items[:, :6] = np.frombuffer(blob, dtype=np.uint8, count=6 * n, offset=1).reshape(n, 6)
    counts = np.frombuffer(blob, dtype=f"<u{width}", offset=1 + 6 * n).astype(np.int64) if width else np.ones(n, dtype=np.int64)
    return items.reshape(-1).view("<i8"), counts


def _counted_bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node and its packed bag, of the texts that have the node's bag."""
    for frame in frames:
        texts = frame["text"].tolist()
        for a, b in S.batches(texts):
            part = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
            h, of = S.shingle_hashes(*S.word_hashes(part, S.SPACES))
            own = [frame[c].iloc[a:b].to_numpy() for c in ("b1", "b2")]
            right = np.logical_and.reduce([x == y for x, y in zip(bag_sums(h, of, b - a), own)])
            d, x, w = count_bags(h >> _U(16), of)
            cuts = np.searchsorted(d, np.arange(b - a + 1))
            yield pd.DataFrame([(n, pack_bag(x[i:j], w[i:j])) for n, i, j, ok in zip(
                frame["node"].iloc[a:b], cuts[:-1], cuts[1:], right) if ok], columns=["node", "bag"])


def overlap(x, cx, y, cy) -> int:
    """Size of the common multiset of two bags (sorted distinct items, counts)."""
    if len(x) > len(y):
        x, cx, y, cy = y, cy, x, cx
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x
    return int(np.minimum(cx[same], cy[at[same]]).sum())


def _similarities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (u, run, side): a run's hub (side 0), then its members."""
    hub = None
    for f in frames:
        out = []
        for u, v, side, bag in zip(f["u"], f["v"], f["side"], f["bag"]):
            x, cx = unpack_bag(bag)
            if side == 0:
                hub = (x, cx, int(cx.sum()))
                continue
            both = overlap(hub[0], hub[1], x, cx)
            out.append((u, v, both / (hub[2] + int(cx.sum()) - both)))
        yield pd.DataFrame(out, columns=["u", "v", "sim"])


def _block_links(threshold: float):
    """Links between the members of two blocks (or within one) of a bucket."""

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        side, reps, far = frame["side"].to_numpy(), frame["node"].to_numpy(), frame["far"].to_numpy(float)
        comps, sizes = frame["root"].to_numpy(), frame["size"].to_numpy()
        items, counts = zip(*map(unpack_bag, frame["bag"]))
        same = not (side == 1).any()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        out = []
        for i in left:
            may = (comps[right] != comps[i]) & ~(np.abs(far[right] - far[i]) > 1 - threshold + 1e-9)  # unknown: may
            may &= np.minimum(sizes[right], sizes[i]) >= threshold * np.maximum(sizes[right], sizes[i])
            for j in right[may & (right > i)] if same else right[may]:
                both = overlap(items[i], counts[i], items[j], counts[j])
                if both >= threshold * (sizes[i] + sizes[j] - both):
                    out.append((reps[i], reps[j]))
        return pd.DataFrame(out, columns=["u", "v"])

    return link


def _classes(documents: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """Of every row: doc_id, text_hash, class_id, bag_id, n_shingles."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    bags = keep(spread(docs.withColumn("text_hash", F.xxhash64("text"))).mapInPandas(
        _bag_rows(bands, rows), "doc_id long, text_hash long, b1 long, b2 long, size long, bands array<long>"), "bags")
    full = bags.filter("size > 0")
    reps = keep(full.groupBy("b1", "b2", "size").agg(
        F.min("doc_id").alias("rep"), F.max("bands").alias("bands")).withColumn(
        "node", F.monotonically_increasing_id()), "reps")
    # the hub is the member with the least doc_id: an original rather than one of its copies
    every = reps.filter("rep is not null").select("node", "rep", "size", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "node", "size")).alias("first")).filter(
        "n > 1").select("key", "n", F.col("first.node").alias("hub"), F.col("first.size").alias("hub_size"))
    members = keep(every.drop("rep").join(shared, "key"), "buckets")
    wanted = reps.select("node", "rep", "b1", "b2").join(members.select("node").distinct(), "node")
    counted = docs.join(wanted, F.col("doc_id") == F.col("rep")).select("node", "b1", "b2", "text").mapInPandas(
        _counted_bags, "node long, bag binary")
    if not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        counted = counted.dropDuplicates(["node"])
    counted = keep(counted, "counted")

    def similarities(pairs: DataFrame, name: str) -> DataFrame:
        """u, v and their similarity; the pairs of one u in runs that get its bag once."""
        placed = keep(pairs.withColumn("run", F.pmod(F.xxhash64("v"), F.lit(RUNS)).cast("int")), f"{name}-pairs")
        theirs = placed.join(counted.withColumnRenamed("node", "v"), "v").select("u", "run", F.lit(1).alias("side"), "v", "bag")
        own = placed.select("u", "run").distinct().join(counted.withColumnRenamed("node", "u"), "u").select(
            "u", "run", F.lit(0).alias("side"), F.col("u").alias("v"), "bag")
        dealt = theirs.unionByName(own).repartition("u", "run").sortWithinPartitions("u", "run", "side")
        return keep(dealt.select("u", "v", "side", "bag").mapInPandas(_similarities, "u long, v long, sim double"), name)

    def may(x: str, y: str):
        return F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)

    stars = similarities(members.filter("node <> hub").filter(may("size", "hub_size")).select(
        F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    near = F.col("sim") >= threshold - 1e-12
    roots = keep(components(stars.filter(near).select("u", "v")), "roots")
    # members of the buckets that still hold several components, with their distance to the hub
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("k"))
    split = sizes.groupBy("key").agg(
        F.sum("k").alias("n"), F.count("*").alias("n_roots"),
        F.max(F.struct("k", "root")).alias("largest")).filter("n > 2 and n_roots > 1")
    far = stars.select(F.col("u").alias("hub"), F.col("v").alias("node"), (1 - F.col("sim")).alias("far"))
    apart = keep(named.drop("n").join(split.select("key", "n", "largest"), "key").join(far, ["hub", "node"], "left").select(
        "key", "node", "size", "root", "hub", F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("far")).alias("far"),
        (F.col("root") != F.col("largest.root")).alias("outside"), (F.col("n") - F.col("largest.k")).alias("n_outside"),
        "n"), "apart")
    found = [stars.filter(near).select("u", "v")]
    few = apart.filter(F.col("n_outside") <= SMALL)
    out = few.filter("outside").select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "root", "far")])
    reach = F.lit(1 - threshold + 1e-9)
    # every row has at most SMALL partners; two outsiders meet once, by order
    direct = few.join(out, "key").filter(
        (F.col("root") != F.col("root2")) & (~F.col("outside") | (F.col("node") < F.col("node2")))
        & (F.col("node") != F.col("hub")) & (F.col("node2") != F.col("hub"))
        & F.coalesce(F.abs(F.col("far") - F.col("far2")) <= reach, F.lit(True)) & may("size", "size2")).select(
        F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()
    found.append(similarities(direct, "direct").filter(near).select("u", "v"))
    # wide buckets: pairs of blocks, compared within a task
    wide = apart.filter(F.col("n_outside") > SMALL)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = wide.withColumn("b", F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o")).select(
        "key", "node", "size", "root", "far", F.least("b", "o").alias("b0"), F.greatest("b", "o").alias("b1"),
        (F.col("b") > F.col("o")).cast("int").alias("side"))
    found.append(keep(met.join(counted, "node").groupBy("key", "b0", "b1").applyInPandas(
        _block_links(threshold), "u long, v long"), "block-links"))
    if not (found[1].isEmpty() and found[2].isEmpty()):
        roots = components(found[0].unionByName(found[1]).unionByName(found[2]))
    # a class is named by its least doc_id
    linked = reps.select("b1", "b2", "size", "rep", "node").join(roots, "node", "left")
    names = linked.filter("root is not null").groupBy("root").agg(F.min("rep").alias("class_id"))
    ids = linked.join(names, "root", "left").select(
        "b1", "b2", "size", F.col("rep").alias("bag_id"), F.coalesce("class_id", "rep").alias("class_id"))
    grouped = full.join(ids, ["b1", "b2", "size"]).select(
        "doc_id", "text_hash", "class_id", "bag_id", F.col("size").alias("n_shingles"))
    lone = bags.filter("size = 0").select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("bag_id"), F.col("size").alias("n_shingles"))
    return grouped.unionByName(lone)


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class),
    bag_id (the least doc_id with the same bag of shingles) and n_shingles."""
    return _classes(documents, threshold, bands, rows).drop("text_hash")


def drop_near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS,
                         rows: int = ROWS) -> DataFrame:
    """The rows of ``documents``, all columns, that have the least id of their class; of
    repeated rows one stays. An id with several texts of one class keeps them all; a row with
    a null doc_id goes if its text's bag is another row's with an id, and stays otherwise."""
    late = _classes(documents, threshold, bands, rows).filter("not (doc_id <=> class_id)").select(
        F.col("doc_id").alias("late_id"), F.col("text_hash").alias("late_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("late_id")) & (F.xxhash64("text") == F.col("late_text"))
    kept = documents.join(late, same, "left_anti")
    twice = documents.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
