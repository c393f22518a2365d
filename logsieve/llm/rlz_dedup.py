"""Removal of word passages that an earlier document has: relative Lempel-Ziv parsing.

A word goes when a window of ``length`` consecutive words that covers it also
starts in a document with a smaller doc_id. All words of all documents count;
windows never cross documents and are judged on the input.

1. *Anchors.* Of the ``gram``-word grams in each window the one with the least hash is
   the window's anchor, so equal windows have equal anchors at equal places. An
   anchor's context is all the words of the windows it can stand for (at most
   2 * length - gram). This leaves one row for about every five words. Equal contexts
   within a slice of a task are combined before the shuffle.
2. *Meeting.* Rows meet by gram, sorted by context and document. A context whose smallest
   document comes first is covered whole in all later ones. A gram in one context only
   has no match. What is left, each distinct context of a gram with several, are the
   edges: there documents agree in a part. Grams that a bounded sample of the documents
   shows to be frequent are dealt over ``SALTS`` tasks by context; all their contexts
   count as edges. The sample moves work only, never the result.
3. *Reference blocks.* The edges' words, whole grams together, are laid end to end in
   bounded blocks, each indexed by a suffix array with the ranks of its
   doubling steps. Every context that may have a match in a block is factored against
   it, from the left: the longest match with a smaller document is the better of the two
   nearest rows of the suffix array, above and below, with a smaller document. A factor
   of ``length`` words or more is a duplicate span. The next factor begins at its end; the
   windows that reach over the border begin up to ``length`` - 1 words before it, and
   they are looked up in the same way.
4. A gram with more contexts than a block may hold is dealt over several blocks; windows
   that none of them covers are compared by their 128-bit hashes over all blocks,
   so no match is lost.

Defined results: words are as in ``[^\\x20\\x09-\\x0D]+``; a null or word-free text has none (0
words, the digest of nothing); rows with a null doc_id neither lose nor remove words;
rows with equal doc_ids do not remove each other's words; an empty table gives an empty
result; other columns of the input are ignored. Words are equal by 64 hash bits, whole
contexts by 64 more over those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread

LENGTH = 13
GRAM = 5
#: Contexts of one gram that may share a block, and words after which a block is closed.
GROUP = 4096
BLOCK_WORDS = 1 << 17
#: Documents looked at to find frequent grams, the share of them that makes a gram
#: frequent, and the tasks that such a gram is dealt over.
SAMPLE, FREQUENT, SALTS = 2000, 0.005, 64
#: Grams dealt over several blocks that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 100_000

_U = np.uint64
_I = np.int64
_RANGE = _I(1 << 62)
_SUB = _I((1 << 29) - 1)


def _over(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every window of ``width`` values, by doubling."""
    w = 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[:len(x) - (width - w)], x[width - w:]) if width > w else x


def anchors(words: np.ndarray, first: np.ndarray, length: int, gram: int):
    """(text number, place in the text, gram hash, context hash) of all anchors, of
    words laid end to end; ``first``: each text's first word, and their number."""
    n, reach = len(words), length - gram + 1
    if n < length:
        none = np.empty(0, dtype=_I)
        return none, none, none, none
    of_word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    back = S._powers(S._R_INV, n)
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    np.cumsum((words | _U(1)) * S._powers(S._R, n) + (words >> _U(1)) * S._powers(S._R, n + 7)[7:], out=sums[1:])
    g = S.mixed((sums[gram:] - sums[:-gram]) * back[:n - gram + 1])
    least = _over(g, reach, np.minimum)
    least[of_word[:n - length + 1] != of_word[length - 1:]] = 0  # windows over two texts
    pad = np.zeros(reach - 1, dtype=_U)
    at = np.flatnonzero(_over(np.concatenate((pad, least, pad)), reach, np.maximum) == g)
    of = of_word[at]
    lo, hi = np.maximum(at - (reach - 1), first[of]), np.minimum(at + length, first[of + 1])
    c = S.mixed((sums[hi] - sums[lo]) * back[lo] + S.mixed((at - lo).astype(_U) * _U(4096) + (hi - lo).astype(_U)))
    return of, at - first[of], g[at].view(_I), c.view(_I)


def joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Ranges of each document, one where they overlap or touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    number = np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1])))
    lift = number * (int(hi.max()) + 1)  # documents one after the other
    top = np.maximum.accumulate(hi + lift)
    starts = np.flatnonzero(np.concatenate(([True], (lo + lift)[1:] > top[:-1])))
    ends = np.concatenate((starts[1:], [len(doc)])) - 1
    return doc[starts], lo[starts], top[ends] - lift[ends]


def _hashed(texts: list[str | None]):
    return S.word_hashes([(t or "").encode("utf-8", "replace") for t in texts], S.SPACES)


def _gram_counts(length: int, gram: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in S.batches(texts):
                of, _, g, _ = anchors(*_hashed(texts[a:b]), length, gram)
                yield pd.DataFrame({"g": g, "of": of}).drop_duplicates()[["g"]]

    return scan


def frequent_grams(told: DataFrame, length: int, gram: int, sample: int = SAMPLE, share: float = FREQUENT) -> list[int]:
    """Grams in at least ``share`` of a sample of about ``sample`` documents."""
    n = told.count()
    some = told.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) * n < F.lit(sample << 20))
    counts = some.select("text").mapInPandas(_gram_counts(length, gram), "g long").groupBy("g").count()
    most = counts.filter(F.col("count") >= max(8, share * min(n, sample))).orderBy(F.desc("count"), "g")
    return [r["g"] for r in most.limit(10_000).collect()]


ROWS = "k long, g long, c long, doc long, at long"


def _anchor_rows(length: int, gram: int, frequent: list[int], salts: int):
    """Rows for the shuffle, by k: anchors, and ranges that a smaller document of the
    same slice covers. ``at``: place | sub << 32; a range has its end in c."""
    often = np.sort(np.array(frequent, dtype=_I))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids, subs = frame["text"].tolist(), frame["doc_id"].to_numpy(_I), frame["sub"].to_numpy(_I)
            for a, b in S.batches(texts, 4 << 20):
                of, at, g, c = anchors(*_hashed(texts[a:b]), length, gram)
                doc, sub = ids[a:b][of], subs[a:b][of]
                order = np.lexsort((doc, c, g))
                of, at, g, c, doc, sub = (x[order] for x in (of, at, g, c, doc, sub))
                new = np.ones(len(g), dtype=bool)
                new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
                later = doc > doc[new][np.cumsum(new) - 1] if len(g) else new
                o, lo, hi = joined(of[later], np.maximum(at[later] - (length - gram), 0), at[later] + length)
                rows = ids[a:b][o]
                key = S.mixed(rows.view(_U) * _U(31) + lo.view(_U)).view(_I)
                here = ~later
                g, c = g[here], c[here]
                k = g.copy()
                if len(often):
                    hot = often[np.minimum(np.searchsorted(often, g), len(often) - 1)] == g
                    k[hot] = S.mixed(g[hot].view(_U) + S.mixed(c[hot].view(_U)) % _U(salts)).view(_I)
                yield pd.DataFrame({
                    "k": np.concatenate((k, key)), "g": np.concatenate((g, key)), "c": np.concatenate((c, hi)),
                    "doc": np.concatenate((doc[here], rows)),
                    "at": np.concatenate((at[here] | sub[here] << _I(32), lo | subs[a:b][o] << _I(32) | _RANGE))})

    return scan


FOUND = "doc long, sub long, lo long, hi long, g long"
_FOUND = pa.schema([(n, pa.int64()) for n in ("doc", "sub", "lo", "hi", "g")])


def _found(doc, at, lo, hi, g) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(doc), pa.array((at >> _I(32)) & _SUB), pa.array(lo), pa.array(hi),
        pa.array(g, mask=hi != 0)], schema=_FOUND)


def _meet(length: int, gram: int, frequent: list[int]):
    """Of rows sorted by (g, c, doc): covered ranges (g null) and edges (hi 0). An edge of a
    gram's first context waits until a second one shows up, perhaps batches later."""
    often = np.sort(np.array(frequent, dtype=_I))
    none = _I(0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_now, context_now, least, several = None, None, none, False
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            g, c, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            ready = (at & _RANGE) != 0
            if ready.any():
                r = at[ready]
                yield _found(doc[ready], r, r & _I(0x7FFFFFFF), c[ready], r)
                g, c, doc, at = (x[~ready] for x in (g, c, doc, at))
            if not len(g):
                continue
            fresh_g = np.concatenate(([g[0] != gram_now], g[1:] != g[:-1]))
            fresh_c = fresh_g.copy()
            fresh_c[0] |= c[0] != context_now
            fresh_c[1:] |= c[1:] != c[:-1]
            leasts = np.concatenate(([least], doc[fresh_c]))
            first = leasts[np.cumsum(fresh_c)]
            number = np.cumsum(fresh_g)  # 0: the gram that is open from before
            many = np.zeros(number[-1] + 1, dtype=bool)
            many[number[fresh_c & ~fresh_g]] = True
            many[0] |= several
            if len(often):
                many[number] |= often[np.minimum(np.searchsorted(often, g), len(often) - 1)] == g
            if waiting:
                if many[0]:
                    yield from waiting
                if many[0] or number[-1] > 0:
                    waiting = []
            place = at & _I(0x7FFFFFFF)
            covered = doc > first
            send = covered | many[number]
            lo = np.where(covered, np.maximum(place - (length - gram), 0), place)
            hi = np.where(covered, place + length, 0)
            if send.any():
                yield _found(doc[send], at[send], lo[send], hi[send], g[send])
            later = ~send & (number == number[-1])
            if later.any():
                waiting.append(_found(doc[later], at[later], lo[later], hi[later], g[later]))
            gram_now, context_now, least, several = g[-1], c[-1], first[-1], bool(many[-1])

    return scan


def _contexts(length: int, gram: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in S.batches(texts):
                words, first = _hashed(texts[a:b])
                rows = []
                for i, (doc, sub, edges) in enumerate(zip(frame["doc"].iloc[a:b], frame["sub"].iloc[a:b],
                                                          frame["edges"].iloc[a:b])):
                    for e in edges:
                        lo = max(0, e["lo"] - (length - gram))
                        part = words[first[i] + lo:min(first[i] + e["lo"] + length, first[i + 1])]
                        rows.append((e["g"], e["salt"], e["salts"], doc, sub, lo, part.tobytes()))
                yield pd.DataFrame(rows, columns=["g", "salt", "salts", "doc", "sub", "lo", "words"])

    return cut


class Reference:
    """An indexed reference block: contexts laid end to end, each with its document."""

    def __init__(self, contexts: list[np.ndarray], docs: np.ndarray, reach: int):
        sizes = np.array([len(x) for x in contexts], dtype=_I)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        n = int(sizes.sum()) + len(sizes)
        body = np.ones(n, dtype=bool)
        body[self.starts + sizes] = False
        symbols = np.empty(n, dtype=_I)
        _, symbols[body] = np.unique(np.concatenate([*contexts, np.empty(0, dtype=_U)]), return_inverse=True)
        symbols[~body] = n + np.arange(len(sizes))  # each context is closed by a symbol of its own
        # ranks of all runs of 1, 2, 4, ... words; equal ranks are equal runs
        self.steps: list[tuple[int, np.ndarray]] = []
        rank, width = np.unique(symbols, return_inverse=True)[1].astype(_I), 1
        while True:
            self.steps.append((width, np.concatenate((rank, np.full(width, -1)))))
            if width >= reach:
                break
            rest = np.full(n, -1, dtype=_I)
            rest[:max(0, n - width)] = rank[width:]
            rank, width = np.unique(rank * _I(n + 2) + rest + 1, return_inverse=True)[1].astype(_I), 2 * width
        self.order = np.argsort(rank, kind="stable")
        self.row = np.empty(n, dtype=_I)
        self.row[self.order] = np.arange(n)
        # least document of 1, 2, 4, ... neighbouring rows of the suffix array
        self.least = [np.repeat(docs, sizes + 1)[self.order]]
        while 2 << len(self.least) <= 2 * n:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            if len(last) <= half:
                break
            self.least.append(np.minimum(last[:-half], last[half:]))
        self.n = n

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Number of equal words from places p and q on."""
        out = np.zeros(len(p), dtype=_I)
        p, q = p.copy(), q.copy()
        for width, rank in reversed(self.steps):
            inside = (p < self.n) & (q < self.n)
            same = inside & (rank[np.minimum(p, self.n - 1)] == rank[np.minimum(q, self.n - 1)])
            step = same * width
            out, p, q = out + step, p + step, q + step
        return out

    def longest(self, p: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Length of the longest match of the words from p on with a smaller document."""
        row = self.row[p]
        above, below = row.copy(), row.copy()  # rows [above, row) and (row, below] hold no smaller one
        for j in range(len(self.least) - 1, -1, -1):
            span, least = 1 << j, self.least[j]
            up = np.flatnonzero(above >= span)
            up = up[least[above[up] - span] >= doc[up]]
            above[up] -= span
            down = np.flatnonzero(below + span < self.n)
            down = down[least[below[down] + 1] >= doc[down]]
            below[down] += span
        out = np.zeros(len(p), dtype=_I)
        for near, has in ((above - 1, above > 0), (below + 1, below < self.n - 1)):
            k = np.flatnonzero(has)
            out[k] = np.maximum(out[k], self.common(p[k], self.order[near[k]]))
        return out


def factor(contexts: list[np.ndarray], docs: np.ndarray, length: int):
    """Relative Lempel-Ziv parse of every context against all smaller documents of the block:
    (context number, start, end) of the factors with at least ``length`` words."""
    sizes = np.array([len(x) for x in contexts], dtype=_I)
    block = Reference(contexts, docs, int(sizes.max(initial=1)))
    at = np.zeros(len(contexts), dtype=_I)
    open_ = np.flatnonzero(sizes >= length)
    found = []
    while len(open_):
        size = block.longest(block.starts[open_] + at[open_], docs[open_])
        long_ = size >= length
        found.append((open_[long_], at[open_[long_]], at[open_[long_]] + size[long_]))
        # the windows within a factor are settled; the next ones reach over its end
        at[open_] += np.where(long_, size - length + 1, 1)
        open_ = open_[at[open_] + length <= sizes[open_]]
    if not found:
        return (np.empty(0, dtype=_I),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _parse(length: int):
    """Covered ranges of each block's contexts (h1 null), and for grams dealt over several
    blocks the hashes of the windows left."""

    def block(rows: list) -> pd.DataFrame:
        contexts = [np.frombuffer(r[6], dtype=_U) for r in rows]
        doc, sub, low = (np.array([r[k] for r in rows], dtype=_I) for k in (3, 4, 5))
        of, lo, hi = factor(contexts, doc, length)
        hashes: list[tuple] = []
        dealt = np.flatnonzero([r[2] > 1 for r in rows])
        if len(dealt):
            gone = {(i, p) for i, x, y in zip(of.tolist(), lo.tolist(), hi.tolist()) for p in range(x, y - length + 1)}
            for i in dealt.tolist():
                for p in range(len(contexts[i]) - length + 1):
                    if (i, p) not in gone:
                        h = hashlib.blake2b(contexts[i][p:p + length].tobytes(), digest_size=16).digest()
                        hashes.append((doc[i], sub[i], low[i] + p, low[i] + p + length,
                                       int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
        of, lo, hi = joined(of, lo, hi)
        nothing = pd.array([None] * len(of), "Int64")
        out = pd.DataFrame({"doc": doc[of], "sub": sub[of], "lo": low[of] + lo, "hi": low[of] + hi,
                            "h1": nothing, "h2": nothing})
        if hashes:
            more = pd.DataFrame(hashes, columns=list(out.columns)).astype({"h1": "Int64", "h2": "Int64"})
            out = pd.concat([out, more], ignore_index=True)
        return out

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if size >= BLOCK_WORDS and row[:2] != last:
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) // 8
                last = row[:2]
        if held:
            yield block(held)

    return scan


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """bytes.split() parts at exactly the ASCII white space of the word pattern."""
    for frame in frames:
        rows = []
        for text, found in zip(frame["text"], frame["ranges"]):
            words = (text or "").encode("utf-8", "replace").split()
            spans = []
            if found is not None and len(found):
                lo = np.array([r["lo"] for r in found], dtype=_I)
                hi = np.minimum(np.array([r["hi"] for r in found], dtype=_I), len(words))
                _, lo, hi = joined(np.zeros(len(lo), dtype=_I), lo, hi)
                spans = list(zip(lo.tolist(), hi.tolist()))
            kept, at = [], 0
            for lo, hi in spans:
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(),
                         [{"lo": x, "hi": y} for x, y in spans]))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": [r[0] for r in rows], "n_removed": [r[1] for r in rows],
                            "kept_sha256": [r[2] for r in rows], "removed": [r[3] for r in rows]})


def repeated_passages(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (the word ranges taken out) of
    every document."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    twice = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    sub = F.lit(0).cast("long") if twice.isEmpty() else F.pmod(F.xxhash64("text"), F.lit(1 << 29))
    docs = docs.withColumn("sub", sub)
    told = docs.filter(f"doc_id is not null and octet_length(text) >= {2 * length - 1}")
    often = frequent_grams(told, length, gram)
    rows = spread(told).mapInPandas(_anchor_rows(length, gram, often, SALTS), ROWS)
    found = keep(rows.repartition("k").sortWithinPartitions("g", "c", "doc").mapInArrow(
        _meet(length, gram, often), FOUND), "anchors")
    edges = found.filter("g is not null")
    ranges = found.filter("g is null").select("doc", "sub", "lo", "hi")
    dealt = keep(edges.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts")).filter("salts > 1"),
                 "dealt-grams")
    # few as a rule: then the edges of a gram need not meet to learn its salts
    if dealt.count() <= BROADCAST_GRAMS:
        dealt = F.broadcast(dealt)
    salted = edges.join(dealt, "g", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn(
        "salt", F.pmod(F.xxhash64("doc", "sub", "lo"), F.col("salts")).cast("int"))
    lists = salted.groupBy("doc", "sub").agg(F.collect_list(F.struct("g", "salt", "salts", "lo")).alias("edges"))
    texts = told.select(F.col("doc_id").alias("doc"), "sub", "text")
    cut = texts.join(lists, ["doc", "sub"]).mapInPandas(
        _contexts(length, gram), "g long, salt int, salts int, doc long, sub long, lo long, words binary")
    parsed = keep(cut.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInPandas(
        _parse(length), "doc long, sub long, lo long, hi long, h1 long, h2 long"), "parsed")
    left = parsed.filter("h1 is not null")
    least = left.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    late = left.join(least, ["h1", "h2"]).filter("doc > least").select("doc", "sub", "lo", "hi")
    every = ranges.unionByName(parsed.filter("h1 is null").select("doc", "sub", "lo", "hi")).unionByName(late)
    by_doc = every.groupBy(F.col("doc").alias("doc_id"), "sub").agg(
        F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return docs.join(by_doc, ["doc_id", "sub"], "left").select("doc_id", "text", "ranges").mapInPandas(
        _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<lo:long,hi:long>>")
