"""Alignment of two tokenizers' tokens over a corpus, by external spill counting.

Every text is encoded twice, by a byte-level BPE (A) and by a sentence piece model
(B), over the same bytes. Byte offsets where tokens of both end cut them into
groups; tokens whose byte ranges overlap are links. A pair of ids counts in how
many documents it is linked, over the whole corpus.

1. *Records.* A task encodes its texts in batches and makes one record for each
   document and pair that it holds. About ``RECORDS`` records are a chunk: sorted by
   pair (A's id first), packed as byte planes and compressed with zstd.
2. *Runs.* A chunk's pairs, with the number of their records, are partitioned by a
   hash of A's id into ``PARTS`` parts; a part is a compressed run in blocks. At the
   end of a task the runs of a part are merged by a heap over block ends.
   Only these runs are shuffled: a pair that stands in every document is one entry a
   task, so no pair is hot.
3. *Counts.* The runs of a part meet, at most ``FAN`` at a time, and are merged again,
   until one run a part is left. Its pairs are in order of A's ids, so an id's highest
   count is known once its pairs have passed. All pairs of an A id are in one part.
4. *Back.* Every run gets the totals of its pairs and whether they are their A id's highest; a
   chunk unpacks its records, and adds up its documents' contributions. Nothing
   goes through the driver; a task holds one part's distinct pairs (bounded by the
   vocabularies) or one chunk.

Defined results: null and empty texts, and texts that one of the two tokenizers does
not give back byte by byte, have no tokens: zeros and an empty digest. Every row is a
document of its own, also with equal or null doc_ids. An empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import keep, spread

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Records of a chunk, parts of the pairs, runs merged at a time, pairs of a run's block.
RECORDS, PARTS, FAN, BLOCK = 1 << 20, 64, 256, 1 << 13
#: Documents of a chunk.
DOCS = 1 << 15

# --- fixed values: the byte-level BPE's splitting rule ------------------------
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ------------------------------------------------------------------------------

_I = np.int64
_U = np.uint64
_LOADED: dict = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class ByteBpe:
    """A: ids and bytes of the byte-level BPE. Where ids are in order of the merges,
    merging by rank gives the same tokens and is faster; texts it refuses, and other
    files, go through the file's own library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = {i: bytes(letters[c] for c in word) for word, i in vocab.items() if word not in special}
        self.bytes = [tokens.get(i, b"") for i in range(max([*tokens, *special.values()]) + 1)]
        for content, i in special.items():
            self.bytes[i] = content.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        base = len(tokens) - len(merges)
        by_rank = base == 256 and not spec["normalizer"] and all(
            vocab[a + b] == base + k for k, (a, b) in enumerate(pairs))
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = None
        if by_rank:
            import tiktoken

            self.fast = tiktoken.Encoding("by_rank", pat_str=SPLIT, special_tokens={},
                                          mergeable_ranks={b: i for i, b in tokens.items()})

    def encode(self, texts: list[str]) -> list:
        out = []
        for t in texts:
            ids = None
            if self.fast is not None:
                try:
                    ids = self.fast.encode_ordinary(t)
                except Exception:  # noqa: BLE001 - the splitting rule's own limit on very long runs
                    ids = None
            out.append(self.slow.encode(t, add_special_tokens=False).ids if ids is None else ids)
        return out


class Pieces:
    """B: ids and bytes of the sentence piece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


def loaded(folder: str) -> tuple:
    """Both tokenizers of a folder, once a Python worker."""
    if folder not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        a, b = ByteBpe(os.path.join(folder, BYTE_BPE)), Pieces(os.path.join(folder, PIECES))
        sizes = [np.array([len(x) for x in t.bytes], dtype=_I) for t in (a, b)]
        # an id's decimal text, a place for the sign after it, and both together's length
        top = max(len(a.bytes), len(b.bytes))
        wide = len(str(top)) + 1
        text = np.zeros((top, wide), dtype=np.uint8)
        size = np.empty(top, dtype=_I)
        for i in range(top):
            d = str(i).encode()
            text[i, :len(d)] = np.frombuffer(d, dtype=np.uint8)
            size[i] = len(d)
        _LOADED[folder] = (a, b, *sizes, text, size)
    return _LOADED[folder]


def encoded(texts: list[str | None], folder: str) -> tuple[list, list, list]:
    """Of each text A's ids, B's ids and the bytes of space + text; empty where the
    text has no tokens."""
    a, b, *_ = loaded(folder)
    rows = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in rows]
    out_a, out_b, raw = [[] for _ in texts], [[] for _ in texts], [b"" for _ in texts]
    for i, t, x, y in zip(rows, spaced, a.encode(spaced), b.encode([texts[i] for i in rows])):
        whole = t.encode("utf-8", "replace")
        if b"".join(map(a.bytes.__getitem__, x)) == whole == b"".join(map(b.bytes.__getitem__, y)):
            out_a[i], out_b[i], raw[i] = x, y, whole
    return out_a, out_b, raw


def align(texts: list[str | None], folder: str):
    """(numbers of tokens a, b, groups, links of each text; digest of each text's
    groups; records: text number, A's id, B's id, links)."""
    ids_a, ids_b, raw = encoded(texts, folder)
    _, _, len_a, len_b, digits, n_digits = loaded(folder)
    n = len(texts)
    n_a = np.array([len(x) for x in ids_a], dtype=_I)
    n_b = np.array([len(x) for x in ids_b], dtype=_I)
    size = np.array([len(x) for x in raw], dtype=_I)
    a = np.fromiter((i for x in ids_a for i in x), dtype=_I, count=int(n_a.sum()))
    b = np.fromiter((i for x in ids_b for i in x), dtype=_I, count=int(n_b.sum()))
    total = int(size.sum())
    none = np.empty(0, dtype=_I)
    if not total:
        zero = np.zeros(n, dtype=_I)
        return (n_a, n_b, zero, zero), [""] * n, (none, none, none, none)
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    in_a, in_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
    in_a[end_a], in_b[end_b] = True, True
    # between two neighbouring cuts of either kind lies one link
    cuts = np.flatnonzero(in_a | in_b)
    link_a = np.cumsum(in_a, dtype=np.int32)[cuts - 1]
    link_b = np.cumsum(in_b, dtype=np.int32)[cuts - 1]
    ends = np.cumsum(size)
    link_of = np.searchsorted(ends, cuts, side="left")
    shared = in_a & in_b
    groups_before = np.cumsum(shared, dtype=np.int32)
    group_ends = np.flatnonzero(shared)
    n_groups = np.bincount(np.searchsorted(ends, group_ends, side="left"), minlength=n)
    n_links = np.bincount(link_of, minlength=n)
    digests = _group_digests(a, b, groups_before[end_a - 1], groups_before[end_b - 1], len(group_ends),
                             n_groups, digits, n_digits)
    # one record for each text and pair
    vocab = _U(len(len_b))
    bits = _U(int(len(len_a) * len(len_b)).bit_length())
    key = np.sort((link_of.astype(_U) << bits) | (a[link_a].astype(_U) * vocab + b[link_b].astype(_U)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    links = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    pair = key & ((_U(1) << bits) - _U(1))
    return (n_a, n_b, n_groups, n_links), digests, ((key >> bits).astype(_I), pair // vocab, pair % vocab, links)


def _group_digests(a, b, group_a, group_b, groups, n_groups, digits, n_digits) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2`` of each text."""
    many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    start = np.concatenate(([0], np.cumsum(many_a + many_b)))
    first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    tokens = np.empty(len(a) + len(b), dtype=_I)
    tokens[start[group_a] + np.arange(len(a)) - first_a[group_a]] = a
    tokens[start[group_b] + many_a[group_b] + np.arange(len(b)) - first_b[group_b]] = b
    sign = np.full(len(tokens), ord(","), dtype=np.uint8)
    sign[start[:-1] + many_a - 1] = ord("|")
    sign[start[1:] - 1] = ord(";")
    size = n_digits[tokens]
    text = digits[tokens]
    text[np.arange(len(tokens)), size] = sign
    flat = text[np.arange(text.shape[1]) <= size[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(size + 1)))
    last = ends[start[np.cumsum(n_groups)]].tolist()
    out, at = [], 0
    for end in last:
        out.append(hashlib.sha256(flat[at:end - 1]).hexdigest() if end > at else "")
        at = end
    return out


# --- packed arrays ---------------------------------------------------------------

_ZIP = zstandard.ZstdCompressor(level=1)
_UNZIP = zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    body = _ZIP.compress(np.ascontiguousarray(planes).tobytes())
    return struct.pack("<IIB", len(body), len(x), width) + body


def unpack(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(the integers packed at a place, the place after them)."""
    size, n, width = struct.unpack_from("<IIB", blob, at)
    at += 9
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_UNZIP.decompress(blob[at:at + size]), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(_I), at + size


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    x, at = unpack(blob, at)
    return np.cumsum(x), at


def pack_run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: sorted pairs and counts, in blocks."""
    return b"".join(pack_sorted(pairs[k:k + BLOCK]) + pack(counts[k:k + BLOCK]) for k in range(0, len(pairs), BLOCK))


def read_run(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(blob):
        pairs, at = unpack_sorted(blob, at)
        counts, at = unpack(blob, at)
        yield pairs, counts


def merge_runs(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted union of runs, counts added up, piece by piece: one block of each
    run is open, heaps name the least open end and the runs that begin before it."""
    runs = [read_run(x) for x in blobs]
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heads: list[tuple[int, int]] = []
    ends: list[tuple[int, int]] = []

    def push(k: int, pairs: np.ndarray, counts: np.ndarray) -> None:
        open_[k] = (pairs, counts)
        heapq.heappush(heads, (int(pairs[0]), k))

    def advance(k: int) -> None:
        block = next(runs[k], None)
        if block is not None:
            push(k, *block)
            heapq.heappush(ends, (int(block[0][-1]), k))

    for k in range(len(runs)):
        advance(k)
    while ends:
        end = ends[0][0]
        got = []
        while heads and heads[0][0] <= end:
            _, k = heapq.heappop(heads)
            pairs, counts = open_.pop(k)
            cut = int(np.searchsorted(pairs, end, side="right"))
            got.append((pairs[:cut], counts[:cut]))
            if cut < len(pairs):
                push(k, pairs[cut:], counts[cut:])
        while ends and ends[0][0] == end:
            advance(heapq.heappop(ends)[1])
        pairs, counts = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        yield pairs[first], np.add.reduceat(counts, first)


def whole_run(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    got = list(pieces)
    if not got:
        return np.empty(0, dtype=_I), np.empty(0, dtype=_I)
    return tuple(np.concatenate(x) for x in zip(*got))


def totals(pairs: np.ndarray, counts: np.ndarray, vocab: int) -> np.ndarray:
    """2 * count + (it is the highest of its A id), of pairs in order."""
    if not len(pairs):
        return counts
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] // vocab != pairs[:-1] // vocab)))
    best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.concatenate((first, [len(pairs)]))))
    return 2 * counts + (counts == best)


# --- tasks -----------------------------------------------------------------------

CHUNK = ("task int, part int, run binary, doc_id array<long>, n_a array<long>, n_b array<long>, "
         "n_groups array<long>, n_links array<long>, digest array<string>, records binary")


class _Chunk:
    """The documents and records gathered for one chunk."""

    def __init__(self):
        self.docs, self.stats, self.digests, self.records = [], [], [], []
        self.n = 0

    def add(self, ids, stats, digests, records) -> None:
        of, a, b, links = records
        self.records.append((of + len(self.docs), a, b, links))
        self.docs.extend(ids)
        self.stats.append(np.stack(stats))
        self.digests.extend(digests)
        self.n += len(of)

    def close(self, task: int, vocab: int, parts: int, runs: list[list[bytes]]) -> pd.DataFrame:
        of, a, b, links = (np.concatenate(x) for x in zip(*self.records))
        pair = a.astype(_I) * vocab + b.astype(_I)
        order = np.argsort(pair, kind="stable")  # records are in order of documents
        of, pair, links = of[order], pair[order], links[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else [])
        counts = np.diff(np.concatenate((first, [len(pair)])))
        pairs = pair[first]
        part = part_of(pairs // vocab, parts)
        for p in np.unique(part):
            mine = part == p
            runs[p].append(pack_run(pairs[mine], counts[mine]))
        # documents ascend within a pair: differences, the first one as it is
        step = np.diff(of, prepend=0)
        step[first] = of[first]
        stats = np.concatenate(self.stats, axis=1)
        return pd.DataFrame([{
            "task": task, "part": None, "run": None, "doc_id": self.docs,
            **{name: stats[k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "digest": self.digests,
            "records": pack_sorted(pairs) + pack(counts) + pack(step) + pack(links)}])


def part_of(a: np.ndarray, parts: int) -> np.ndarray:
    return (S.mixed(a.astype(_U)) % _U(parts)).astype(_I)


def _chunks(folder: str, records: int, parts: int):
    """Chunks of a task, then its runs."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        vocab = len(loaded(folder)[1].bytes)
        runs: list[list[bytes]] = [[] for _ in range(parts)]
        chunk = _Chunk()
        for frame in frames:
            texts = frame["text"].tolist()
            ids = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for x, y in S.batches(texts):
                chunk.add(ids[x:y], *align(texts[x:y], folder))
                if chunk.n >= records or len(chunk.docs) >= DOCS:
                    yield chunk.close(task, vocab, parts, runs)
                    chunk = _Chunk()
        if chunk.docs:
            yield chunk.close(task, vocab, parts, runs)
        for p, blobs in enumerate(runs):
            if blobs:
                run = blobs[0] if len(blobs) == 1 else pack_run(*whole_run(merge_runs(blobs)))
                yield pd.DataFrame([{"task": task, "part": p, "run": run, "doc_id": None, "n_a": None, "n_b": None,
                                     "n_groups": None, "n_links": None, "digest": None, "records": None}])

    return scan


def _merge_up(frame: pd.DataFrame) -> pd.DataFrame:
    run = pack_run(*whole_run(merge_runs(frame["run"].tolist())))
    return pd.DataFrame([{"part": frame["part"].iloc[0], "grp": frame["grp"].iloc[0], "run": run}])


def _answers(frame: pd.DataFrame, pairs: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
    """Each run's pairs with their marks, one run at a time."""
    out = []
    for run in frame["run"]:
        mine, _ = whole_run(read_run(run))
        out.append(pack_run(mine, marks[np.searchsorted(pairs, mine)]))
    return pd.DataFrame({"part": frame["part"], "id": frame["id"], "answer": out})


def _count_top(vocab: int):
    """All runs of a part: counts, then each run's answer."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = whole_run(merge_runs(frame["run"].tolist()))
        return _answers(frame, pairs, totals(pairs, counts, vocab))

    return count


def _pass_down(children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    if not len(children):
        return pd.DataFrame({"part": [], "id": [], "answer": []})
    return _answers(children, *whole_run(read_run(parent["answer"].iloc[0])))


def _documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A chunk's documents with the counts of their links."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            n = len(row.doc_id)
            pairs, at = unpack_sorted(row.records)
            counts, at = unpack(row.records, at)
            step, at = unpack(row.records, at)
            links, at = unpack(row.records, at)
            known = [whole_run(read_run(x)) for x in (row.answers if row.answers is not None else [])]
            if len(pairs):
                keys, marks = (np.concatenate(x) for x in zip(*known))
                order = np.argsort(keys)
                marks = marks[order][np.searchsorted(keys[order], pairs)]
                # undo the differences within each pair
                sums = np.cumsum(step)
                first = np.cumsum(counts) - counts
                of = sums - np.repeat(sums[first] - step[first], counts)
                mark = np.repeat(marks, counts)
                sum_ = np.zeros(n, dtype=_I)
                np.add.at(sum_, of, (mark >> 1) * links)
                best = np.zeros(n, dtype=_I)
                np.add.at(best, of, (mark & 1) * links)
            else:
                sum_, best = np.zeros(n, dtype=_I), np.zeros(n, dtype=_I)
            yield pd.DataFrame({
                "doc_id": pd.array([None if d is None or d != d else int(d) for d in row.doc_id], "Int64")
                if any(d is None or d != d for d in row.doc_id) else np.asarray(row.doc_id, dtype=_I),
                "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups, "n_links": row.n_links,
                "n_best": best, "count_sum": sum_, "groups_sha256": list(row.digest)})


def align_documents(documents: DataFrame, folder: str = TOKENIZERS, records: int = RECORDS, parts: int = PARTS,
                    fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of
    every document. ``folder``: where the vocabulary files are, on every machine."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    chunks = keep(spread(docs).mapInPandas(_chunks(folder, records, parts), CHUNK), "chunks")
    vocab = len(loaded(folder)[1].bytes)
    level = chunks.filter("part is not null").select("part", F.col("task").cast("long").alias("id"), "run")
    top = level.agg(F.max("id")).first()[0] or 0
    below = []
    while top >= fan:
        level = level.withColumn("grp", F.floor(F.col("id") / fan).cast("long"))
        below.append(level)
        level = keep(level.groupBy("part", "grp").applyInPandas(_merge_up, "part int, grp long, run binary"),
                     "runs").withColumnRenamed("grp", "id")
        top //= fan
    answers = level.groupBy("part").applyInPandas(_count_top(vocab), "part int, id long, answer binary")
    for level in reversed(below):
        answers = level.groupBy("part", "grp").cogroup(
            keep(answers.withColumnRenamed("id", "grp"), "answers").groupBy("part", "grp")).applyInPandas(
            _pass_down, "part int, id long, answer binary")
    by_task = answers.groupBy(F.col("id").cast("int").alias("task")).agg(F.collect_list("answer").alias("answers"))
    whole = chunks.filter("part is null").drop("part", "run").join(by_task, "task", "left")
    return whole.mapInPandas(
        _documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                    "groups_sha256 string")
