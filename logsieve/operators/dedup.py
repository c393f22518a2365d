"""Near-duplicate trimming ("trim") as Spark jobs.

The original is a greedy pass in input order: each entry not yet claimed
becomes a leader and claims every later unclaimed entry of the same level whose
source passes D5 and whose message is D4-similar to the leader's. Here:

1. **Exact collapse (D9).** Entries with equal ``(lower(level), lower(source),
   normalised message)`` are indistinguishable to the rules, so they form one
   node (weight = #entries, order = first entry). Lossless; partial
   aggregation makes hot templates cheap. Nodes are numbered in input order.
2. **Held nodes (D7).** Only some nodes, the held ones, look for later similar nodes; all
   others must in the end be absorbed by a held leader. That makes the result the
   sequential pass's: held nodes are settled among themselves on all their pairs, and
   by induction over the input order every node meets the same leaders. A node
   starts as held unless a word sketch (MinHash bands) leads it to an earlier undecided
   node that it is really similar to; so of a cluster, wherever it first occurs, little
   more than the earliest node is held, and its pairs grow with its size, not its
   square. Nodes that no held leader absorbs go through the same step again, with a
   growing share of them held at once, so the number of rounds is bounded. Sketches
   and shares change the work, not the result.
3. **Candidates from selective keys.** Two nodes meet only when they share a key
   that every similar pair shares:
   - equal messages (rule 1): the message hash with a prefix bigram of the source;
   - word overlap (rules 4-6), where one message has up to 32 words: the later message's
     *prefix* words (its rarest words, cut where the remaining repeats could no longer
     reach the overlap that rule 5/6 needs), for each size of the other side's word set:
     exact sizes up to 8, then classes of half as much again;
   - word overlap of longer messages: prose shares most of its words, so that their prefix
     words meet nearly everywhere. Blocks of nodes of about one length meet instead, and
     matrix products of hashed words bound each pair's overlap from above (``_Blocks``);
   - containment (rule 2), 4 or more words: the rarest pair of neighbouring inner
     words of the shorter text; 3 words: the inner word with the beginning of the
     last one; 1-2 words: the rarest byte 6-gram.
   Keys hold the level and byte-length bucket (lengths within 2x, rule 2). Then
   the exact rules D4 and D5 decide on ids, lengths and word counts.
4. **Settling.** Among the held nodes, those that no undecided node points to lead; what
   they point to is absorbed; edges of decided nodes go. Every round decides at
   least the first undecided node, so the loop ends. Tables between the steps are
   written to the shared checkpoint folder.
5. **Counts (D8).** An absorbed node belongs to its smallest-order leader;
   ``duplicate_count = leader weight + absorbed weights`` (BIGINT).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import (
    bytes_text,
    common_words,
    early_decision,
    jaccard_decision,
    long_similarity_at_least,
    normalize,
    source_gate,
    words,
)
from ..functions.text import pinned
from ..schema import ENTRY_COLUMNS, SIMILARITY_THRESHOLD
from ..session import dropped, scratch, written

# A pair on the Jaccard path needs common >= 0.64/1.64 * (|set1| + |words2|); this is a
# little below 16/41 = 0.3902 for float safety.
_OVERLAP_SHARE = 0.39
# ... and its Jaccard similarity at least 0.64.
_JACCARD = 0.639
# With lengths that an edit distance of a fifth can't bridge, the similarity must be 0.8 and
# the overlap 0.8/1.8 of that sum.
_FAR_SHARE = 0.444
# Pairs of messages of more words than this are bounded in blocks.
_LONG = 32
# A block: lengths within a ratio, a share of all words within these bounds, cut at multiples of
# so many nodes.
_BLOCK_RATIO, _BLOCK_SHARE, _BLOCK_WORDS, _CELL = 1.2, 32, (1_200_000, 8_000_000), 256
# Words of blocks, and bytes of texts, that one round of pairs shuffles: all nodes' once, or this.
_ROUND_WORDS, _ROUND_TEXT = 32_000_000, 128_000_000
# Texts of more bytes than this have their edit distance taken by bit vectors.
_LONG_TEXT = 512
# A task's cells (bytes of one text by bytes of the other), and the most tasks.
_TASK_CELLS, _MOST_TASKS = 2e10, 20_000
# Pairs whose nodes are sent to all tasks, so that only their texts are shuffled.
_FEW_PAIRS = 200_000
# Edges that one task settles.
_FEW_EDGES = 200_000
# Open nodes that are all held at once after the first round.
_FEW_OPEN = 4_096
# Character-gram length for short-text containment.
_GRAM = 6
# Longest word beginning that keys three-word containment.
_BEGIN = 8
# Inner pairs that a long message tries.
_TRIED_PAIRS = 8
# Word sketches: bands of so many least hashes; earlier nodes tried for each node.
_BANDS, _ROWS, _TRIED = 6, 2, 2
# Share of the open nodes that is held anyway: 1/4096 at first, then 8 times more a round.
_SHARE, _GROWTH = 4096, 8


def entry_nodes(entries: DataFrame) -> DataFrame:
    """One row per (lower level, lower source, normalised message)."""
    norm = F.col("norm") if "norm" in entries.columns else normalize(F.col("message"))
    keyed = entries.select(
        F.lower("level").alias("lvl"),
        F.lower("source").alias("lsrc"),
        norm.alias("norm"),
        F.col("ord"),
        F.struct(*[F.col(c) for c in ENTRY_COLUMNS]).alias("row"),
    )
    return keyed.groupBy("lvl", "lsrc", "norm").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min("ord").alias("node"),
        F.min_by("row", "ord").alias("row"),
    )


def numbered(nodes: DataFrame) -> DataFrame:
    """``seq``: 0, 1, ... in input order. Range-partitioned and sorted, so a row's
    number is its place in its partition plus the sizes of those before it (one
    count per partition on the driver)."""
    ids = nodes.select("node").repartitionByRange("node").sortWithinPartitions("node").select(
        "node", F.monotonically_increasing_id().alias("id"))
    ids = written(ids, "numbered")
    part = F.shiftright("id", 33)
    sizes = ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["part"], at))
        at += r["n"]
    if not starts:
        return nodes.withColumn("seq", F.lit(0).cast("bigint"))
    offsets = nodes.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    seq = ids.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "node", (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("seq"))
    return nodes.join(seq, "node")


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (not numbered yet) as a table with their numbers and what ``_node_attrs`` adds."""
    with scratch() as made:
        # texts are compressed harder: they are most of the bytes
        return made.keep(written(_measured(numbered(written(nodes, "nodes", "zstd"))), "nodes", "zstd"))


def _measured(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the numbers of words and of bytes."""
    w = words(F.col("norm"))
    nlen = F.octet_length("norm")
    return nodes.withColumns({
        "nwords": F.size(w),
        # words are compared by 64-bit hashes
        "ndistinct": F.coalesce(F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))), F.lit(0)),
        "nlen": nlen,
        "bucket": F.when(nlen == 0, F.lit(-1)).otherwise(F.floor(F.log2(nlen))).cast("int")})


def _node_attrs(nodes: DataFrame) -> DataFrame:
    """The rules' view of numbered nodes. Words are split from ``norm`` where they are needed:
    a table of them is larger than the texts."""
    measured = nodes if "ndistinct" in nodes.columns else _measured(nodes)
    return measured.select("seq", "lvl", "lsrc", "norm", "nwords", "ndistinct", "nlen", "bucket")


def _with_words(attrs: DataFrame) -> DataFrame:
    return pinned(attrs, words=words(F.col("norm")))


def _near_buckets(df: DataFrame) -> DataFrame:
    """Explode a probe side to its own and both neighbouring length buckets."""
    return df.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))


def _size_class(n: Column) -> Column:
    """Classes of word-set sizes: 1 to 8 exact, then half as much again each."""
    return F.when(n <= 8, n).otherwise(8 + F.floor(F.log(n / F.lit(8.0)) / F.log(F.lit(1.5)) + F.lit(1e-9))).cast("int")


def _least_of_class(c: Column) -> Column:
    """The smallest size a class may hold (a little less is harmless)."""
    return F.when(c <= 8, c.cast("double")).otherwise(8.0 * F.pow(F.lit(1.5), c - 8) - F.lit(1e-6))


class Keys:
    """The key tables of all nodes, built once and written. ``probe`` meets
    ``index`` (either may be the earlier node); ``later`` meets ``earlier``."""

    def __init__(self, attrs: DataFrame):
        self.blocks = _Blocks(attrs.where(F.col("nwords") > _LONG))
        with scratch() as made:
            # a pair's word counts are within 2x
            brief = attrs.where(F.col("nwords") <= 2 * _LONG)
            self.earlier, self.later = (made.keep(written(t, "overlap-keys")) for t in _overlap_keys(brief))
            probes, indexes = zip(*(f(attrs) for f in (_inner_pairs, _three_words, _short_texts)))
            self.probe = made.keep(written(_union(list(probes)), "probe-keys"))
            self.index = made.keep(written(_union(list(indexes)), "index-keys"))
            self.equal = made.keep(written(_equal_message_keys(attrs), "equal-keys"))

    def candidates(self, first: DataFrame | None = None) -> DataFrame:
        """Distinct ``(a, b)``, a before b, with a common key; a one of ``first`` (a
        frame of ``seq``; none: all nodes)."""

        def of(table: DataFrame) -> DataFrame:
            return table if first is None else table.join(first, "seq", "left_semi")

        def alike(size: str) -> Column:
            return 2 * F.least(f"i.{size}", f"p.{size}") >= F.greatest(f"i.{size}", f"p.{size}")

        overlap = (
            self.later.alias("p").join(of(self.earlier).alias("i"), "key")
            .where((F.col("i.seq") < F.col("p.seq")) & alike("nlen") & alike("nwords")
                   & (F.least("i.nwords", "p.nwords") <= _LONG))
            .groupBy(F.col("i.seq").alias("a"), F.col("p.seq").alias("b"))
            .agg(F.sum("p.mult").alias("matched"), F.first("p.suffix_mass").alias("suffix_mass"),
                 F.first("p.nwords").alias("nwords"), F.first("i.ndistinct").alias("ndistinct"))
            # matched prefix repeats and all repeats outside the prefix bound the overlap
            .where(F.col("matched") + F.col("suffix_mass")
                   >= F.lit(_OVERLAP_SHARE) * (F.col("ndistinct") + F.col("nwords")))
            .select("a", "b")
        )

        def met(x: DataFrame, y: DataFrame) -> DataFrame:
            return x.alias("x").join(y.alias("y"), "key").where(F.col("x.seq") < F.col("y.seq")).select(
                F.col("x.seq").alias("a"), F.col("y.seq").alias("b"))

        parts = [overlap, self.blocks.candidates(first), met(of(self.probe), self.index), met(of(self.index), self.probe),
                 met(of(self.equal), self.equal)]
        return _union(parts).distinct()


class _Blocks:
    """Pairs of long messages whose word overlap may suffice. Each node's words are packed
    once as 32-bit hashes with their repeats. Two blocks of nodes of one level, with lengths
    within 2x, give the product of a 0/1 matrix (earlier nodes, hashed words) and a matrix of
    counts (later nodes): at least the overlap, as a word counts wherever its hash is taken.
    Pairs that pass are counted again on the hashes. All pairs of long messages are met, so
    the products grow with the square of their number; memory is bounded by the block. A block
    is sent once for each block it meets, in rounds that shuffle no more than all nodes once,
    so disk grows with the nodes."""

    def __init__(self, attrs: DataFrame):
        rows = attrs.select("seq", "lvl", "nlen", "nwords", "ndistinct",
                            F.transform(words(F.col("norm")), lambda w: F.hash(w)).alias("h"))
        bin_ = F.floor(F.log(F.col("nlen").cast("double")) / F.log(F.lit(_BLOCK_RATIO))).cast("int")
        packed = rows.mapInPandas(_packed, "seq bigint, lvl string, nlen int, nwords int, ndistinct int, words binary")
        self.nodes = written(packed.withColumn("bin", bin_), "packed")
        self.n_words = self.nodes.agg(F.sum("nwords")).first()[0] or 0
        least, most = _BLOCK_WORDS
        self.block_words = max(least, min(most, self.n_words // _BLOCK_SHARE))
        self.all = self._cut(self.nodes, "y")

    def _cut(self, nodes: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        """``nodes`` with their ``part``, and the blocks with their words, first and last node. Cells
        of neighbouring nodes are added up in order, so a block has about ``block_words``."""
        cell = F.floor(F.col("seq") / _CELL)
        before = Window.partitionBy("lvl", "bin").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = nodes.groupBy("lvl", "bin", cell.alias("cell")).agg(
            F.sum("nwords").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).withColumn(
            "part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / self.block_words).cast("int"))
        cells = written(cells, "cells")
        cut = nodes.withColumn("cell", cell).join(cells.select("lvl", "bin", "cell", "part"), ["lvl", "bin", "cell"])
        blocks = cells.groupBy("lvl", "bin", "part").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        names = {c: f"{side}{c}" for c in ("bin", "part", "lo", "hi", "n")}
        return (cut.drop("cell").withColumnsRenamed(names), blocks.withColumnsRenamed(names))

    def candidates(self, first: DataFrame | None = None) -> DataFrame:
        """``(a, b)``, a before b, as a table."""
        with scratch() as made:
            earlier = self.nodes if first is None else self.nodes.join(first, "seq", "left_semi")
            x, xblocks = self._cut(earlier, "x")
            y, yblocks = self.all
            reach = int(math.log(2) / math.log(_BLOCK_RATIO)) + 1
            pairs = xblocks.withColumn("ybin", F.explode(F.sequence(F.col("xbin") - reach, F.col("xbin") + reach))).join(
                yblocks, ["lvl", "ybin"]).where(F.col("xlo") < F.col("yhi")).select(
                "lvl", "xbin", "xpart", "ybin", "ypart", (F.col("xn") + F.col("yn")).alias("n"))
            pairs = written(pairs, "block-pairs")
            moved = pairs.agg(F.sum("n")).first()[0] or 0
            rounds = math.ceil(moved / max(_ROUND_WORDS, self.n_words)) or 1
            key = ["lvl", "xbin", "xpart", "ybin", "ypart"]
            found = []
            for r in range(rounds):
                now = pairs.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == r).drop("n")
                left = x.join(now, ["lvl", "xbin", "xpart"])
                right = y.join(now, ["lvl", "ybin", "ypart"])
                # columns of their own for the later side, which comes from the same table
                right = right.select(*[F.col(c).alias(f"later_{c}") for c in right.columns])
                met = left.groupBy(*key).cogroup(right.groupBy(*[f"later_{c}" for c in key])).applyInPandas(
                    _bounded, "a bigint, b bigint")
                found.append(written(met, "block-candidates"))
            return made.keep(found[0] if rounds == 1 else written(_union(found), "block-candidates"))


def _packed(frames):
    """The words of each row as 32-bit hashes, as often as they occur, in order."""
    import numpy as np

    for f in frames:
        yield f.drop(columns=["h"]).assign(words=[np.sort(np.asarray(h, np.int32).view(np.uint32)).tobytes() for h in f["h"]])


def _bounded(xs, ys):
    """Two blocks: the pairs, earlier first, whose overlap may suffice."""
    import numpy as np
    import pandas as pd

    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if xs.empty or ys.empty:
        return none
    ys = ys.rename(columns=lambda c: c.removeprefix("later_"))
    xw, yw = ([np.frombuffer(w, np.uint32) for w in f["words"]] for f in (xs, ys))
    xw = [np.unique(w) for w in xw]
    side = {n: (xs[n].to_numpy(np.int64), ys[n].to_numpy(np.int64)) for n in ("seq", "nlen", "nwords", "ndistinct")}
    # a fifth of the columns taken: words of one hash seldom make up for what a pair lacks
    width = max(256, int(4 * np.mean(side["ndistinct"][0])))

    def matrix(rows):
        at = np.repeat(np.arange(len(rows)), [len(w) for w in rows]) * width + np.concatenate(rows) % width
        return np.bincount(at, minlength=len(rows) * width).reshape(len(rows), width).astype(np.float32)

    step, found = max(1, min(1024, (1 << 22) // width)), []
    for y0 in range(0, len(yw), step):
        of = slice(y0, y0 + step)
        counts = matrix(yw[of])
        for x0 in range(0, len(xw), step):
            xo = slice(x0, x0 + step)
            least = np.minimum.outer(side["nlen"][0][xo], side["nlen"][1][of])
            most = np.maximum.outer(side["nlen"][0][xo], side["nlen"][1][of])
            n1, n2 = side["nwords"][0][xo][:, None], side["nwords"][1][of][None, :]
            ok = ((side["seq"][0][xo][:, None] < side["seq"][1][of][None, :]) & (2 * least > most)
                  & (2 * n1 >= n2) & (2 * n2 >= n1))
            if not ok.any():
                continue
            share = np.where(5 * least >= 4 * most - 5, _OVERLAP_SHARE, _FAR_SHARE)
            need = share * (side["ndistinct"][0][xo][:, None] + n2)
            over = np.minimum(matrix(xw[xo]), 1) @ counts.T
            a, b = np.nonzero(ok & (over >= need - 1e-3))
            found.append((a + x0, b + y0, need[a, b]))
    if not found:
        return none
    a, b, need = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(a, kind="stable")
    a, b, need = a[order], b[order], need[order]
    keep = np.zeros(len(a), bool)
    ends = np.flatnonzero(np.diff(a)) + 1
    for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(a)]) if len(a) else ():
        mine = xw[a[lo]]
        for at in range(lo, hi, 4096):
            rows = [yw[k] for k in b[at:min(hi, at + 4096)]]
            flat = np.concatenate(rows)
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            common = np.add.reduceat(hit, np.r_[0, np.cumsum([len(r) for r in rows])[:-1]], dtype=np.int64)
            keep[at:at + len(rows)] = common >= need[at:at + len(rows)] - 1e-6
    return pd.DataFrame({"a": side["seq"][0][a[keep]], "b": side["seq"][1][b[keep]]})


def _overlap_keys(attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules 4-6: the words of the earlier node, the prefix words of the later. Keys hold the
    level, the word and the class of the earlier node's set size; lengths and word counts go
    along and are compared where two rows meet."""
    base = ("seq", "lvl", "nlen", "nwords", "ndistinct")
    index = written(attrs.select(*base, F.explode(words(F.col("norm"))).alias("word")).groupBy(
        *base, F.xxhash64("word").alias("h")).agg(F.count(F.lit(1)).alias("c")), "overlap-words")
    freq = index.groupBy("lvl", "h").agg(F.count(F.lit(1)).alias("df"))
    tail = Window.partitionBy("seq").orderBy(F.desc("df"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = index.join(freq, ["lvl", "h"]).withColumn("from_here", F.sum("c").over(tail)).groupBy(*base).agg(
        F.collect_list(F.struct("from_here", "h", "c")).alias("w"))
    # For an earlier set of d words the overlap must reach share * (n + d). It is at most n, and
    # every own word that the smaller set can't hold takes at least one from that.
    n, own = F.col("nwords"), F.col("ndistinct")

    def reachable(cls: Column) -> Column:
        least, most = _least_of_class(cls), F.floor(_least_of_class(cls + 1) - F.lit(1e-3))
        need = F.lit(_OVERLAP_SHARE) * (n + least)
        return (need <= n) & (n - F.greatest(F.lit(0), own - most) >= need)

    classes = F.filter(F.sequence(F.lit(1), _size_class(F.lit(2) * n)), reachable)
    need = F.lit(_OVERLAP_SHARE) * (n + _least_of_class(F.col("cls")))
    outside = F.transform(F.filter("w", lambda x: x["from_here"] < F.col("need")), lambda x: x["from_here"])
    by_class = pinned(marked.withColumn("cls", F.explode(classes)), need=need)
    # pinned: once for a node and class, not once for each of its words
    later = pinned(by_class, suffix_mass=F.coalesce(F.array_max(outside), F.lit(0)),
                   inside=F.filter("w", lambda x: x["from_here"] >= F.col("need"))).select(
        *base, "cls", "suffix_mass", F.inline("inside"))
    key = F.xxhash64("lvl", "h", "cls")
    earlier = index.withColumn("cls", _size_class(F.col("ndistinct")))
    return (earlier.select("seq", key.alias("key"), "ndistinct", "nwords", "nlen"),
            later.select("seq", key.alias("key"), F.col("c").alias("mult"), "suffix_mass", "nwords", "nlen"))


def _rarest(probes: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One key of each probing node, the rarest in the index, for its own and the
    neighbouring buckets. Both sides: seq, lvl, bucket, kind, text."""
    same = ["lvl", "kind", "text"]
    # of the index only what some probe asks for
    index = written(index.join(probes.select(*same).distinct(), same, "left_semi"), "asked-keys")
    freq = index.groupBy(*same).agg(F.count(F.lit(1)).alias("df"))
    best = probes.join(freq, same).groupBy("seq", "lvl", "bucket", "kind").agg(
        F.min_by("text", F.struct("df", "text")).alias("text"))
    key = F.xxhash64("lvl", "bucket", "kind", "text")
    return _near_buckets(best).select("seq", key.alias("key")), index.select("seq", key.alias("key"))


def _inner_pairs(attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule 2, 4 or more words in the shorter text: its inner words are words of
    the longer one, neighbours stay neighbours."""
    w = F.col("words")

    def pairs(hi: Column, lo: int, cols: Callable) -> Column:
        return F.transform(F.sequence(F.lit(lo), hi), lambda i: cols(F.get(w, i - 1), F.get(w, i)))

    attrs = _with_words(attrs)
    # by hash: an equal hash of other words is one more candidate
    base = ("seq", "lvl", "bucket", F.lit("pair").alias("kind"))
    index = attrs.where("nwords >= 2").select(*base, F.explode(F.array_distinct(
        pairs(F.col("nwords") - 1, 1, lambda x, y: F.xxhash64(x, y)))).alias("text"))
    # any inner pair serves; a long message looks for its rarest among its longest ones
    inner = F.array_sort(pairs(F.col("nwords") - 2, 2, lambda x, y: F.struct(
        (-F.length(x) - F.length(y)).alias("short"), F.xxhash64(x, y).alias("text"))))
    tried = F.slice(inner, F.lit(1), F.when(F.col("nwords") <= _LONG, F.lit(_LONG)).otherwise(F.lit(_TRIED_PAIRS)))
    probes = attrs.where("nwords >= 4").select(*base, F.explode(F.array_distinct(
        F.transform(tried, lambda x: x["text"]))).alias("text"))
    return _rarest(probes, index)


def _three_words(attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule 2, 3 words: the inner word, and the word after it begins like the last."""
    w = F.col("words")
    last = F.get(w, F.lit(2))
    base = ("seq", "lvl", "bucket", F.lit("three").alias("kind"))
    probes = _with_words(attrs.where("nwords = 3")).select(*base, F.concat(
        F.get(w, F.lit(1)), F.lit(" "), F.substring(last, F.lit(1), F.least(F.length(last), F.lit(_BEGIN)))).alias("text"))
    near = _near_buckets(attrs.where("nwords = 3").select("lvl", "bucket").distinct()).distinct()
    reach = attrs.where("nwords >= 2").join(near, ["lvl", "bucket"], "left_semi")
    index = _with_words(reach).select(*base, F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("nwords") - 1),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.length(F.get(w, i)), F.lit(_BEGIN))),
            lambda n: F.concat(F.get(w, i - 1), F.lit(" "), F.substring(F.get(w, i), F.lit(1), n))))))).alias("text"))
    key = F.xxhash64("lvl", "bucket", "kind", "text")
    return _near_buckets(probes).select("seq", key.alias("key")), index.select("seq", key.alias("key"))


def _short_texts(attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule 2, 1-2 words: the rarest byte gram of the shorter text."""
    short = attrs.where("nwords >= 1 and nwords <= 2")
    b8 = bytes_text(F.col("norm"))
    size = F.least(F.col("nlen"), F.lit(_GRAM)).cast("int")
    base = ("seq", "lvl", "bucket", F.lit("gram").alias("kind"))
    probes = short.select(*base, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.col("nlen") - size + 1), lambda i: F.substring(b8, i, size)))).alias("text"))
    near = _near_buckets(short.select("lvl", "bucket").distinct()).distinct()
    # only texts in a (level, length bucket) that some short text can reach
    index = _window_grams(attrs.join(near, ["lvl", "bucket"], "left_semi")).select(*base, F.col("gram").alias("text"))
    return _rarest(probes, index)


def _equal_message_keys(attrs: DataFrame) -> DataFrame:
    """Rule 1: same level and normalised message, different (lower-cased) sources
    that can pass D5.

    D5 needs both sources non-empty and ``1 - lev/M > 0.7``, i.e. at most
    0.3 M byte edits. Such strings share at least ``M - 1 - 2 * edits >=
    0.4 M - 1`` byte bigrams (counted with repeats), so with each bigram
    occurrence as a token and a global rarity order, two matching sources share
    a token inside both of their prefixes of ``n - ceil(0.4 len - 1) + 1``
    tokens (Sarawagi & Kirpal's prefix filter). Sources of fewer than 3 bytes
    can only pass by being equal, which the exact collapse already merged.
    The key holds the message hash, so no message group emits all of its
    source pairs."""
    h = attrs.select("seq", "lvl", F.xxhash64("norm").alias("h"), bytes_text(F.col("lsrc")).alias("s8"))
    shared = h.groupBy("lvl", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    cand = h.join(shared.drop("n"), ["lvl", "h"], "left_semi").where(F.length("s8") >= 3)
    pinned_grams = pinned(cand, _grams=F.transform(
        F.sequence(F.lit(1), F.length("s8") - 1), lambda i: F.substring("s8", i, 2)
    ))
    occ = pinned_grams.select("seq", "lvl", "h", F.length("s8").alias("slen"),
                              F.posexplode("_grams").alias("pos", "gram"))
    nth = Window.partitionBy("seq", "gram").orderBy("pos")
    tokens = occ.withColumn("token", F.concat(F.col("gram"), F.lit("#"), F.row_number().over(nth).cast("string")))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare_first = Window.partitionBy("seq").orderBy("df", "token")
    need = F.ceil(F.col("slen") * F.lit(0.4) - F.lit(1.0) - F.lit(1e-9))
    return (
        tokens.join(df, "token").withColumn("r", F.row_number().over(rare_first))
        .where(F.col("r") <= (F.col("slen") - 1) - need + 1)
        .select("seq", F.xxhash64("lvl", "h", "token").alias("key"))
    )


def _window_grams(attrs: DataFrame) -> DataFrame:
    """Grams of texts that a <= 2-word text longer than half of them can sit
    in: texts whose longest 1-2-word window exceeds half their length."""
    with_lens = pinned(_with_words(attrs), _lens=F.transform("words", lambda w: F.octet_length(w)))
    lens = F.col("_lens")
    pair_spans = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))),
        lambda i: F.coalesce(F.try_element_at(lens, i), F.lit(0))
        + F.coalesce(F.try_element_at(lens, (i + 1).cast("int")) + 1, F.lit(0)),
    )
    dominated = with_lens.where((F.col("nlen") > 0) & (F.array_max(pair_spans) * 2 > F.col("nlen")))
    # tiny texts: every gram length up to _GRAM; others: _GRAM only
    lengths = F.when(
        F.col("nlen") < 2 * _GRAM, F.sequence(F.lit(1), F.lit(_GRAM))
    ).otherwise(F.array(F.lit(_GRAM)))
    # grams are taken over bytes (one character per byte), like the lengths;
    # built as an array so the exploded rows do not carry the whole text
    b8 = bytes_text(F.col("norm"))
    grams = F.flatten(F.transform(
        F.filter(lengths, lambda q: q <= F.col("nlen")),
        lambda q: F.transform(
            F.sequence(F.lit(1), F.col("nlen") - q + 1), lambda pos: F.substring(b8, pos, q)
        ),
    ))
    return dominated.select("seq", "lvl", "bucket", F.explode(F.array_distinct(grams)).alias("gram"))


def similar_edges(attrs: DataFrame, cand: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` with a before b, passing D5 and D4(a as leader, b), as a table; ``cand``
    names the pairs to look at (none: all).

    First the numbers and sources decide what they can. Then texts are joined to the pairs
    that are left, and each is judged where it is. A text goes along once for each
    of its pairs, so pairs are met in rounds that shuffle no more than all texts once."""
    with scratch() as made:
        if cand is None:
            cand = Keys(attrs).candidates()
        numbers = ("seq", "lsrc", "nlen", "nwords", "ndistinct")

        def side(name: str, cols: tuple, rows: DataFrame = attrs) -> DataFrame:
            return rows.select(*[F.col(c).alias(name if c == "seq" else f"{name}_{c}") for c in cols])

        pairs = cand.join(side("a", numbers), "a").join(side("b", numbers), "b")
        shorter, longer = F.least("a_nlen", "b_nlen"), F.greatest("a_nlen", "b_nlen")
        pairs = pairs.where(source_gate(F.col("a_lsrc"), F.col("b_lsrc")) & ((2 * shorter > longer) | (longer == 0)))
        pairs = written(pairs.drop("a_lsrc", "b_lsrc", "b_ndistinct"), "pairs")
        n, sent, work = pairs.agg(
            F.count(F.lit(1)), F.sum(F.col("a_nlen").cast("bigint")),
            F.sum(F.col("a_nlen").cast("double") * F.col("b_nlen"))).first()
        every = attrs.agg(F.sum(F.col("nlen").cast("bigint"))).first()[0] or 0
        rounds = math.ceil((sent or 0) / max(_ROUND_TEXT, every)) or 1
        # dealt by the work, which bytes don't tell: a few large tasks otherwise
        tasks = max(attrs.sparkSession.sparkContext.defaultParallelism,
                    int(min(_MOST_TASKS, (work or 0.0) / rounds // _TASK_CELLS + 1)))
        found = []
        for r in range(rounds):
            now = pairs if rounds == 1 else pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == r)
            a_rows, b_rows = attrs, attrs
            if n <= _FEW_PAIRS:
                a_rows, b_rows = (attrs.join(F.broadcast(now.select(F.col(x).alias("seq")).distinct()), "seq", "left_semi")
                                  for x in ("a", "b"))
            elif rounds > 1:
                a_rows = attrs.where(F.pmod(F.xxhash64("seq"), F.lit(rounds)) == r)
            texts = ("seq", "norm")
            met = now.join(side("a", texts, a_rows), "a").repartition(tasks, "b").join(
                side("b", texts, b_rows).repartition(tasks, "b"), "b")
            found.append(written(_judged(met).select("a", "b"), "edges"))
        return made.keep(found[0] if rounds == 1 else written(_union(found), "edges"))


def _judged(met: DataFrame) -> DataFrame:
    """D4 on pairs with their texts and numbers: the pairs that pass."""
    longer = F.greatest("a_nlen", "b_nlen")
    staged = pinned(met, early=early_decision(F.col("a_norm"), F.col("b_norm"), F.col("a_nwords"), F.col("b_nwords")))

    def asked(what: str, *texts: Column) -> list[Column]:
        """``texts`` where ``what`` is not decided: others need not go to Python."""
        return [F.when(F.col(what).isNull(), x) for x in texts]

    # rows go to Python by the hundred, so a batch of long texts stays small
    counted = staged.where(F.coalesce("early", F.lit(True))).withColumn("common", F.udf(
        common_words, "int", useArrow=False)(*asked("early", F.col("a_norm"), F.col("b_norm"))))

    def ok(lev_ok: Column | None = None) -> Column:
        return jaccard_decision(F.col("common"), F.col("a_ndistinct"), F.col("b_nwords"), F.col("a_norm"), F.col("b_norm"),
                                lev_ok)

    # null where only the edit distance of long texts is left to ask for
    decided = pinned(counted, ok=F.coalesce(F.col("early"), F.when(
        longer > _LONG_TEXT, ok(F.lit(None).cast("boolean"))).otherwise(ok()))).where(F.coalesce("ok", F.lit(True)))
    return decided.where(F.coalesce(F.col("ok"), long_similarity_at_least(
        *asked("ok", F.lower("a_norm"), F.lower("b_norm")), SIMILARITY_THRESHOLD)))


def _settle(edges: DataFrame) -> DataFrame:
    """The absorbed nodes (``seq``) among the nodes of ``edges``, by rounds: nodes no
    undecided node points to lead. A node that is in no edge leads too. Once few edges are left, one
    task goes through them in order."""
    with scratch() as made:
        active, gone = written(edges, "active"), []
        while (left := active.count()) > _FEW_EDGES:
            leaders = active.select("a").distinct().join(active.select(F.col("b").alias("a")), "a", "left_anti")
            absorbed = written(active.join(leaders, "a", "left_semi").select(F.col("b").alias("seq")).distinct(), "absorbed")
            gone.append(absorbed)
            if len(gone) >= 16:
                # keep the plan short on long chains
                gone = [written(_union(gone), "absorbed")]
            before, active = active, written(
                active.join(absorbed.withColumnRenamed("seq", "b"), "b", "left_anti")
                .join(absorbed.withColumnRenamed("seq", "a"), "a", "left_anti").select("a", "b"), "active")
            dropped(before)
        if left:
            gone.append(active.select("a", "b").repartition(1).mapInPandas(_in_order, "seq bigint"))
        return made.keep(written(_union(gone) if gone else active.select(F.col("b").alias("seq")), "absorbed"))


def _in_order(frames):
    """The nodes that some leader absorbs: a pair's earlier node is decided when the later is met."""
    import pandas as pd

    edges = pd.concat(list(frames), ignore_index=True).sort_values("b")
    gone = set()
    for a, b in zip(edges["a"].tolist(), edges["b"].tolist()):
        if a not in gone:
            gone.add(b)
    yield pd.DataFrame({"seq": sorted(gone)}, dtype="int64")


def _sketches(attrs: DataFrame) -> DataFrame:
    """``(seq, sketch)``: bands of least word hashes, alone and with the source. Nodes of
    similar words share some sketch nearly always."""
    hashed = pinned(attrs.where("nwords > 0"), _h=F.array_distinct(F.transform(
        words(F.col("norm")), lambda w: F.xxhash64(w)))).select("seq", "lvl", "lsrc", "_h")

    def least_of(seed: int) -> Column:
        return F.array_min(F.transform("_h", lambda h: F.xxhash64(h, F.lit(seed))))

    least = [least_of(k) for k in range(_BANDS * _ROWS)]
    mins = pinned(hashed, _m=F.array(*least))
    bands = F.array(*[F.xxhash64("lvl", F.lit(b), *[F.get("_m", F.lit(b * _ROWS + r)) for r in range(_ROWS)])
                      for b in range(_BANDS)])
    both = pinned(mins, _b=bands)
    return both.select("seq", F.explode(F.concat(
        "_b", F.transform("_b", lambda x: F.xxhash64(x, F.col("lsrc"))))).alias("sketch"))


def _followers(attrs: DataFrame, sketches: DataFrame, open_: DataFrame) -> DataFrame:
    """Nodes of ``open_`` (``seq``) that are similar to an earlier one of them which a sketch
    leads to; of those the ``_TRIED`` that share most sketches are tried. Each sketch
    gives pairs with its earliest node only."""
    with scratch() as made:
        mine = sketches.join(open_, "seq", "left_semi")
        heads = mine.groupBy("sketch").agg(F.min("seq").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        shared = mine.join(heads, "sketch").where("seq > a").groupBy("a", F.col("seq").alias("b")).agg(
            F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("b").orderBy(F.desc("n"), "a")
        tried = shared.withColumn("r", F.row_number().over(order)).where(F.col("r") <= _TRIED).select("a", "b")
        return made.keep(written(
            similar_edges(attrs, written(tried, "tried")).select(F.col("b").alias("seq")).distinct(), "followers"))


def greedy_leaders(attrs: DataFrame, share: int = _SHARE, growth: int = _GROWTH, settled: int = 0) -> DataFrame:
    """``(seq, leader)`` of every absorbed node; all others lead. The first ``settled``
    nodes are known to lead: they are held first and have no edges among themselves."""
    with scratch() as made:
        keys, sketches = Keys(attrs), written(_sketches(attrs.where(F.col("seq") >= settled)), "sketches")
        every = attrs.select("seq")
        open_, held, edges = every, [], []
        while True:
            if settled and not held:
                held.append(every.where(F.col("seq") < settled))
            else:
                if held and open_.count() <= _FEW_OPEN:
                    share = 1
                follow = open_.limit(0) if share == 1 else _followers(attrs, sketches, open_)
                anyway = F.pmod(F.xxhash64("seq", F.lit(3)), F.lit(share)) == 0
                held.append(written(open_.join(follow.where(~anyway), "seq", "left_anti"), "held"))
                share = max(1, share // growth)
            with scratch() as step:
                found = keys.candidates(held[-1])
                if settled and len(held) == 1:
                    found = found.where(F.col("b") >= settled)
                edges.append(step.keep(similar_edges(attrs, found)))
            holders, found = _union(held), _union(edges)
            absorbed = _settle(found.join(holders.withColumnRenamed("seq", "b"), "b", "left_semi").select("a", "b"))
            leaders = holders.join(absorbed, "seq", "left_anti")
            claims = written(found.join(leaders.withColumnRenamed("seq", "a"), "a", "left_semi").groupBy(
                F.col("b").alias("seq")).agg(F.min("a").alias("leader")), "claims")
            # a node whose leader was absorbed by a newly held one is open again
            open_ = written(every.join(holders, "seq", "left_anti").join(claims, "seq", "left_anti"), "open")
            if open_.isEmpty():
                return made.keep(claims)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _absorbed(nodes: DataFrame, settled: int = 0, share: int = _SHARE, growth: int = _GROWTH) -> DataFrame:
    """Numbered nodes without the absorbed ones, whose weights go to their leaders."""
    claims = greedy_leaders(_node_attrs(nodes), share, growth, settled)
    more = claims.join(nodes.select("seq", "weight"), "seq").groupBy(F.col("leader").alias("seq")).agg(
        F.sum("weight").alias("more"))
    kept = nodes.join(claims.select("seq"), "seq", "left_anti").join(more, "seq", "left")
    return kept.withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0))).select(
        "lvl", "lsrc", "norm", "weight", "node", "row")


def trimmed_entries(leaders: DataFrame) -> DataFrame:
    """The leader entries with ``duplicate_count`` = entries they stand for."""
    return leaders.select(*[F.col(f"row.{c}").alias(c) for c in ENTRY_COLUMNS if c != "duplicate_count"],
                          F.col("weight").alias("duplicate_count"))


def trim(entries: DataFrame, share: int = _SHARE, growth: int = _GROWTH) -> DataFrame:
    """The leader entries with ``duplicate_count``. ``share`` and ``growth`` change
    the work, not the result."""
    return trimmed_entries(_absorbed(numbered_nodes(entry_nodes(entries)), 0, share, growth))


def trim_appended(leaders: DataFrame | None, entries: DataFrame) -> DataFrame:
    """The leaders (nodes: lvl, lsrc, norm, node, weight, row) after more entries, all of them
    later than those before: what ``trim`` gives for all entries together, without
    reading the earlier ones again. ``leaders``: the table an earlier call returned
    (none at first). Exact, as only leaders absorb: later entries meet the stored leaders and
    each other, and what an earlier absorbed entry was like is never asked again.
    ``trimmed_entries`` gives the entries."""
    with scratch() as made:
        if leaders is None:
            return made.keep(written(_absorbed(numbered_nodes(entry_nodes(entries))), "leaders", "zstd"))
        fresh = written(entry_nodes(entries), "nodes", "zstd")
        # a node equal to a leader is that leader's (no earlier leader is similar to it)
        same = ["lvl", "lsrc", "norm"]
        again = fresh.select(*same, F.col("weight").alias("again"))
        known = numbered(leaders.join(again, same, "left").withColumn(
            "weight", F.col("weight") + F.coalesce("again", F.lit(0))).drop("again"))
        # numbered on their own, so that the stored leaders stay before all others
        n = leaders.count()
        later = numbered(fresh.join(leaders.select(*same), same, "left_anti")).withColumn("seq", F.col("seq") + n)
        nodes = written(_measured(known.unionByName(later)), "nodes", "zstd")
        dropped(fresh)
        return made.keep(written(_absorbed(nodes, n), "leaders", "zstd"))


def trim_report(entries: DataFrame, trimmed: DataFrame) -> DataFrame:
    """D10's log line as a row: original, final, removed."""
    o = entries.agg(F.count(F.lit(1)).alias("original"))
    f = trimmed.agg(F.count(F.lit(1)).alias("final"))
    return o.join(f).select("original", "final", (F.col("original") - F.col("final")).alias("removed"))
