"""Removal of byte strings that an earlier document has: suffix-array dedup with
threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes when a ``length``-byte string that covers it also starts in a
document with a smaller doc_id. All bytes of all documents count; matches never
cross documents.

1. *Anchors.* Of the ``gram``-byte grams in each ``length``-byte window the one
   with the least hash is the window's anchor, so equal windows have equal anchors
   at equal places. An anchor's context is all the bytes of the windows it can
   stand for. This leaves about one row (two hashes, document, place) for every
   16 bytes. Equal contexts within a task are combined before the shuffle.
2. The rows meet by gram. A context whose smallest document comes first is
   covered whole in all later documents: copies are done here by numbers alone. A
   gram that stands in one context only can have no match. What is left are the
   edges: each distinct context of a gram with several, once.
3. *BWT.* The edges' bytes, by gram, are laid end to end in bounded blocks. A
   block's suffixes are sorted, which gives its Burrows-Wheeler transform. Suffix
   intervals are then extended backwards breadth first through the LF mapping, a round
   by as many symbols as are settled, which settles the longest common prefixes in
   increasing order; it stops at ``length``. Rows not parted by then are the windows with
   equal bytes, and all but those of the smallest document are covered.
4. A gram with more contexts than a block may hold is dealt over several blocks;
   windows that no block covers are then compared by their 128-bit hashes over
   all blocks, so no match is lost.

Defined results: a null text counts as empty (0 bytes, nothing removed); rows
with a null doc_id neither lose nor remove bytes; rows with equal doc_ids do not
remove each other's bytes; an empty table gives an empty result; other columns of
the input are ignored. Equality of whole contexts is taken from 128 hash bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread

LENGTH = 50
GRAM = 20
#: Contexts of one gram that may share a block, and bytes after which a block is closed.
GROUP = 4096
BLOCK_BYTES = 1 << 19
#: Grams dealt over several blocks that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 100_000
#: Bytes of text hashed at once, so the arrays stay in the processor's cache.
ANCHOR_BYTES = 1 << 17

_U = np.uint64
_I = np.int64
ROWS = "g long, c long, doc long, at long"
_RANGE = _I(1 << 62)


def _heads(sorted_: np.ndarray) -> np.ndarray:
    """Where a sorted array's groups of equal values begin, as flags."""
    new = np.ones(len(sorted_), dtype=bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return new


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every window of ``width`` values."""
    w = 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[:len(x) - (width - w)], x[width - w:]) if width > w else x


def anchors(texts: list[bytes], length: int, gram: int):
    """(text number, place in the text, gram hash, context hash) of all anchors."""
    sizes = np.array([len(t) for t in texts], dtype=_I)
    off = np.concatenate(([0], np.cumsum(sizes)))
    n, reach = int(off[-1]), length - gram + 1
    none = np.empty(0, dtype=_I)
    if not (sizes >= length).any():
        return none, none, none, none
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    back = S._powers(S._R_INV, n)
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    np.cumsum((b.astype(_U) + _U(1)) * S._powers(S._R, n), out=sums[1:])
    g = S.mixed((sums[gram:] - sums[:-gram]) * back[:n - gram + 1])
    least = _slide(g, reach, np.minimum)  # by window
    for end in off[1:-1]:  # windows that cross into the next text
        least[max(0, end - length + 1):end] = 0
    if len(least) == 0:
        return none, none, none, none
    # a gram is an anchor when it is the least of some window that holds it
    pad = np.zeros(reach - 1, dtype=_U)
    most = _slide(np.concatenate((pad, least, pad)), reach, np.maximum)
    at = np.flatnonzero(most == g)
    of = np.searchsorted(off, at, side="right") - 1
    lo = np.maximum(at - (reach - 1), off[of])
    hi = np.minimum(at + length, off[of + 1])
    c = S.mixed((sums[hi] - sums[lo]) * back[lo] + S.mixed((at - lo).astype(_U) * _U(4096) + (hi - lo).astype(_U)))
    return of, at - off[of], g[at].view(_I), c.view(_I)


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Ranges of each document, joined where they overlap or touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    # running maximum of hi within each document
    span = int(hi.max()) + 1
    number = np.cumsum(new) - 1
    top = np.maximum.accumulate(hi + number * span) - number * span
    first = new.copy()
    first[1:] |= lo[1:] > top[:-1]
    starts = np.flatnonzero(first)
    ends = np.concatenate((starts[1:], [len(doc)])) - 1
    return doc[starts], lo[starts], top[ends]


def _anchor_rows(length: int, gram: int):
    """Rows for the shuffle: anchors, and ranges that a smaller document of the
    same slice covers. ``at``: place | sub << 32; a range has its end in c."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw, ids, subs = frame["text"].tolist(), frame["doc_id"].to_numpy(_I), frame["sub"].to_numpy(_I)
            for a, b in S.batches(raw, 4 << 20):
                texts = [t.encode("utf-8", "replace") for t in raw[a:b]]
                parts = [(x, anchors(texts[x:y], length, gram)) for x, y in S.batches(texts, ANCHOR_BYTES)]
                of = np.concatenate([x + p[0] for x, p in parts])
                at, g, c = (np.concatenate([p[k] for _, p in parts]) for k in (1, 2, 3))
                doc, sub = ids[a:b].take(of), subs[a:b].take(of)
                order = np.argsort(g * _I(31) + c)  # equal contexts next to each other
                new = _heads(g.take(order)) | _heads(c.take(order))
                sorted_ = doc.take(order)
                least = np.minimum.reduceat(sorted_, np.flatnonzero(new)) if len(g) else doc
                # rows stay in order of the texts: neighbours in a document compress well
                later = np.empty(len(g), dtype=bool)
                later[order] = sorted_ > least.take(np.cumsum(new) - 1)
                o, lo, hi = merged(of[later], np.maximum(at[later] - (length - gram), 0), at[later] + length)
                key = S.mixed(ids[a:b][o].view(_U) * _U(31) + lo.view(_U)).view(_I)
                here = ~later
                yield pd.DataFrame({
                    "g": np.concatenate((g[here], key)), "c": np.concatenate((c[here], hi)),
                    "doc": np.concatenate((doc[here], ids[a:b][o])),
                    "at": np.concatenate((at[here] | sub[here] << _I(32), lo | subs[a:b][o] << _I(32) | _RANGE))})

    return scan


FOUND = "doc long, sub long, lo long, hi long, g long"


def _meet(length: int, gram: int):
    """Of rows sorted by (g, c, doc): covered ranges (g null) and edges (hi 0).
    State between batches: the last row, its first document, whether its gram has
    several contexts, and the edges that wait for that."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "sub", "lo", "hi", "g")])

    def out(doc, at, lo, hi, g, no_g):
        sub = (at >> _I(32)) & _I((1 << 29) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(sub), pa.array(lo), pa.array(hi), pa.array(g, mask=no_g)], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # last: (g, c, first document, several contexts)
        for batch in batches:
            g, c, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            ready = (at & _RANGE) != 0
            if ready.any():
                r, low = at[ready], at[ready] & _I(0x7FFFFFFF)
                yield out(doc[ready], r, low, c[ready], r, np.ones(len(r), dtype=bool))
                g, c, doc, at = (x[~ready] for x in (g, c, doc, at))
            if not len(g):
                continue
            place = at & _I(0x7FFFFFFF)
            new_g, new_c = np.ones(len(g), dtype=bool), np.ones(len(g), dtype=bool)
            new_g[1:] = g[1:] != g[:-1]
            new_c[1:] = new_g[1:] | (c[1:] != c[:-1])
            if last is not None:
                new_g[0] = g[0] != last[0]
                new_c[0] = new_g[0] or c[0] != last[1]
            which = np.cumsum(new_c)
            starts = np.concatenate(([last[2] if last is not None else 0], doc[new_c]))
            first = starts[which]
            group = np.cumsum(new_g)
            several = np.zeros(group[-1] + 1, dtype=bool)
            several[group[new_c & ~new_g]] = True
            if last is not None and last[3]:
                several[0] = True
            covered = doc > first
            edge = ~covered & several[group]
            if waiting is not None:
                if several[0]:
                    yield waiting
                    waiting = None
                elif group[-1] > 0:
                    waiting = None
            # edges of the last gram, as long as it has one context
            tail = ~covered & (group == group[-1]) & ~several[group]
            send = covered | edge
            if send.any():
                cov = covered[send]
                p = place[send]
                yield out(doc[send], at[send], np.where(cov, np.maximum(p - (length - gram), 0), p),
                          np.where(cov, p + length, 0), g[send], cov)
            if tail.any():
                zero = np.zeros(int(tail.sum()), dtype=_I)
                fresh = out(doc[tail], at[tail], place[tail], zero, g[tail], zero != 0)
                waiting = fresh if waiting is None else pa.Table.from_batches(
                    [waiting, fresh]).combine_chunks().to_batches()[0]
            last = (g[-1], c[-1], first[-1], bool(several[group[-1]]))

    return scan


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (the last column, binary) compressed one by one: they are most of what the joins
    by document shuffle."""
    for batch in batches:
        texts = [None if b is None else zlib.compress(b, 1) for b in batch.columns[-1].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=batch.schema.names)


def _contexts(length: int, gram: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, sub, text, edges in zip(frame["doc"], frame["sub"], frame["text"], frame["edges"]):
                b = zlib.decompress(text)
                for e in edges:
                    lo = max(0, e["lo"] - (length - gram))
                    rows.append((e["g"], e["salt"], e["salts"], doc, sub, lo, b[lo:e["lo"] + length]))
            yield pd.DataFrame(rows, columns=["g", "salt", "salts", "doc", "sub", "lo", "bytes"])

    return cut


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols. The end of the text sorts lowest."""
    return _closed_order(np.append(s.astype(_U) + _U(1), _U(0)))[0][1:]


def _closed_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffix array of contexts by prefix doubling, the row of each suffix, and the rows
    that differ from the one above within so many first symbols. Symbol 0 closes a
    context, the last one too; of two closing symbols the earlier is the smaller.

    Sort keys hold the place in their low bits, so plain sorts give the order: of suffixes
    that are equal up to their closing symbols the places decide.
    """
    n = len(s)
    bits = n.bit_length()
    width = max(1, int(s.max(initial=0)).bit_length())
    known = (64 - bits) // width
    ahead = np.concatenate((s, np.zeros(known, dtype=s.dtype)))
    key, body = s.astype(_U), s != 0
    for j in range(1, known):  # symbols after a closing one do not count
        symbol = ahead[j:j + n] * body
        key <<= _U(width)
        key |= symbol
        body &= symbol != 0
    key <<= _U(bits)
    key |= np.arange(n, dtype=_U)
    key.sort()
    places = _I((1 << bits) - 1)
    order = key.view(_I) & places
    key >>= _U(bits)
    new = _heads(key) | ~body.take(order)
    first = np.flatnonzero(new)
    rank = np.empty(n, dtype=_I)
    rank[order] = np.repeat(first, np.diff(first, append=n))  # rank: first row of its group
    rows, k = np.flatnonzero(~(new & np.append(new[1:], True))), known
    while len(rows):
        # only rows in groups of several are sorted on; they are not closed within k symbols
        at = order.take(rows)
        if 3 * bits < 64:
            key = rank.take(at) << _I(bits)
            key |= rank.take(at + k)
            key <<= _I(bits)
            key |= at
            key.sort()
            at = key & places
            key >>= _I(bits)
            differs = _heads(key)
        else:
            at = at[np.lexsort((rank[at + k], rank[at]))]
            differs = _heads(rank[at]) | _heads(rank[at + k])
        order[rows] = at
        first = np.flatnonzero(differs)
        rank[at] = np.repeat(rows.take(first), np.diff(first, append=len(rows)))
        rows = rows[~(differs & np.append(differs[1:], True))]
        k *= 2
    return order, rank, new, known


def equal_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, place, class) of every ``length``-byte window of the
    contexts, classes in ascending order; equal classes are equal bytes.

    The contexts are closed by symbols of their own and laid end to end. ``psi``
    is the inverse of the LF mapping, so extending a suffix interval backwards by
    j symbols means: rows k-1 and k, with the same first j symbols, have a common
    prefix j longer than their rests, rows psi^j[k-1] and psi^j[k]. A round extends the
    intervals by as many symbols as are settled, never over ``length``, and settles
    the rows whose common prefix with the row above ends there.
    """
    m = len(contexts)
    sizes = np.array([len(x) for x in contexts], dtype=_I)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    none = np.empty(0, dtype=_I)
    if not (sizes >= length).any():
        return none, none, none
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    body = np.ones(len(text), dtype=bool)
    body[starts + sizes] = False
    # 0 closes, the bytes that occur are 1, 2, ...
    code = np.cumsum(np.bincount(text[body], minlength=256) > 0)
    s = code.astype(np.uint8 if code[-1] < 256 else np.uint16)[text]
    s[~body] = 0
    order, row, parted, known = _closed_order(s)
    if known > length:
        head = s.take(order)
        parted, known = _heads(head) | (head == 0), 1
    open_ = np.flatnonzero(~parted)
    above, below = order.take(open_ - 1), order.take(open_)
    while known < length and len(open_):
        step = min(known, length - known)
        # intervals: number of settled rows so far
        interval = np.cumsum(parted, dtype=np.int32)
        now = interval.take(row.take(above + step)) != interval.take(row.take(below + step))
        parted[open_[now]] = True
        rest = ~now
        open_, above, below = open_[rest], above[rest], below[rest]
        known += step
    of = np.repeat(np.arange(m), sizes + 1).take(order)
    place = order - starts.take(of)
    valid = place + length <= sizes.take(of)
    return of[valid], place[valid], np.cumsum(parted)[valid]


def _expand(length: int):
    """Covered ranges of the contexts of each block (h1 null), and for grams
    dealt over several blocks the hashes of the windows left."""

    def block(rows: list) -> pd.DataFrame:
        contexts = [r[6] for r in rows]
        of, place, cls = equal_windows(contexts, length)
        doc = np.array([r[3] for r in rows], dtype=_I)
        sub = np.array([r[4] for r in rows], dtype=_I)
        low = np.array([r[5] for r in rows], dtype=_I)
        mine, new = doc.take(of), _heads(cls)
        least = np.minimum.reduceat(mine, np.flatnonzero(new)) if len(cls) else mine
        later = mine > least.take(np.cumsum(new) - 1)
        o, lo, hi = merged(of[later], place[later], place[later] + length)
        out = pd.DataFrame({"doc": doc[o], "sub": sub[o], "lo": low[o] + lo, "hi": low[o] + hi,
                            "h1": pd.array([None] * len(o), "Int64"), "h2": pd.array([None] * len(o), "Int64")})
        dealt = np.array([r[2] > 1 for r in rows], dtype=bool)
        rest = ~later & dealt[of]
        if rest.any():
            more = []
            for i, p in zip(of[rest], place[rest]):
                h = hashlib.blake2b(contexts[i][p:p + length], digest_size=16).digest()
                more.append((doc[i], sub[i], low[i] + p, low[i] + p + length,
                             int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
            extra = pd.DataFrame(more, columns=list(out.columns)).astype({"h1": "Int64", "h2": "Int64"})
            out = pd.concat([out, extra], ignore_index=True)
        return out

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if (size >= BLOCK_BYTES or len(held) >= 50_000) and row[:2] != last:
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
                last = row[:2]
        if held:
            yield block(held)

    return scan


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text, found in zip(frame["doc_id"], frame["text"], frame["ranges"]):
            b = b"" if text is None else zlib.decompress(text)
            spans = []
            if found is not None and len(found):
                lo = np.array([r["lo"] for r in found], dtype=_I)
                hi = np.minimum(np.array([r["hi"] for r in found], dtype=_I), len(b))
                _, lo, hi = merged(np.zeros(len(lo), dtype=_I), lo, hi)
                spans = list(zip(lo.tolist(), hi.tolist()))
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(b[at:lo])
                at = hi
            kept = b"".join([*kept, b[at:]])
            rows.append((doc, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": [r[1] for r in rows], "n_removed": [r[2] for r in rows],
                            "n_spans": [r[3] for r in rows], "kept_sha256": [r[4] for r in rows],
                            "removed": [[{"lo": x, "hi": y} for x, y in r[5]] for r in rows]})


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (the byte
    ranges taken out) of every document."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    twice = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    sub = F.lit(0).cast("long") if twice.isEmpty() else F.pmod(F.xxhash64("text"), F.lit(1 << 29))
    docs = docs.withColumn("sub", sub)
    told = docs.filter(f"doc_id is not null and octet_length(text) >= {length}")
    rows = spread(told).mapInPandas(_anchor_rows(length, gram), ROWS)
    found = keep(rows.repartition("g").sortWithinPartitions("g", "c", "doc").mapInArrow(
        _meet(length, gram), FOUND), "anchors")
    edges = found.filter("g is not null")
    ranges = found.filter("g is null").select("doc", "sub", "lo", "hi")
    dealt = keep(edges.groupBy("g").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts")).filter("salts > 1"),
                 "dealt-grams")
    # few as a rule: then the edges of a gram need not meet to learn its salts
    if dealt.count() <= BROADCAST_GRAMS:
        dealt = F.broadcast(dealt)
    salted = edges.join(dealt, "g", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn(
        "salt", F.pmod(F.xxhash64("doc", "sub", "lo"), F.col("salts")).cast("int"))
    lists = salted.groupBy("doc", "sub").agg(F.collect_list(F.struct("g", "salt", "salts", "lo")).alias("edges"))
    binary = F.col("text").cast("binary").alias("text")
    texts = told.select(F.col("doc_id").alias("doc"), "sub", binary).mapInArrow(_packed, "doc long, sub long, text binary")
    cut = texts.join(lists, ["doc", "sub"]).mapInPandas(
        _contexts(length, gram), "g long, salt int, salts int, doc long, sub long, lo long, bytes binary")
    expanded = keep(cut.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInPandas(
        _expand(length), "doc long, sub long, lo long, hi long, h1 long, h2 long"), "expanded")
    left = expanded.filter("h1 is not null")
    least = left.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    late = left.join(least, ["h1", "h2"]).filter("doc > least").select("doc", "sub", "lo", "hi")
    every = ranges.unionByName(expanded.filter("h1 is null").select("doc", "sub", "lo", "hi")).unionByName(late)
    by_doc = every.groupBy(F.col("doc").alias("doc_id"), "sub").agg(
        F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    whole = docs.select("doc_id", "sub", binary).mapInArrow(_packed, "doc_id long, sub long, text binary")
    return whole.join(by_doc, ["doc_id", "sub"], "left").select("doc_id", "text", "ranges").mapInPandas(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                  "removed array<struct<lo:long,hi:long>>")
