"""A Merkle manifest of a dataset whose parents keep hash states.

Every row is a leaf; per source the leaves ascend by doc_id, and every three
neighbours become a parent until one node, the source's subroot, is left; the
subroots by source are combined in the same way to the root.

1. *Leaves* are hashed by Spark's own functions and written with a row number.
2. *Places.* Leaves are range partitioned by (tree, doc_id, leaf, row number) and
   sorted, so a hot source is spread over many partitions. A task numbers the runs
   of each tree; only a partition's first run needs an offset, so the driver sees
   one row a partition.
3. *Climbing.* ``HEIGHT`` levels at a time: 3**HEIGHT neighbours meet in a task,
   many such blocks in one batch of numpy. A parent keeps the SHA-256 state before
   each child slot. Every node gets its *path*, and for each level of it: its slot, the number
   of children, the state before the slot and the siblings. Blocks are the nodes
   of the next climb; the number of climbs grows with the logarithm of the rows.
4. *Folding.* A leaf's path is its own, then its block's, and so on to the root.
   Folding a replacement resumes the state before its slot with the replacement
   and the right siblings only; left siblings are never hashed again.

Defined results: null in any column is hashed as ``-``; a null doc_id comes first
in its source; of rows with one doc_id the one with the lesser leaf comes first,
and repeated rows are leaves of their own; a null source is the first tree. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sha_midstate as M
from .common import keep, spread
from .sampling import remainder

#: Levels of a climb: 3**7 nodes meet in a task.
HEIGHT = 7
#: Nodes of whole blocks worked on at once.
BATCH = 8192
#: Path entry of a level: slot, number of children, state before the slot, siblings.
ENTRY = 2 + 32 + 64

_I = np.int64


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """The hash of a documents row, with ``text`` as its text."""
    return F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")],
                                   _field(text)), 256))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds part, run (number of the tree within the partition) and pos (place in the run)."""
    part = TaskContext.get().partitionId()
    run, at, last = -1, 0, None
    for f in frames:
        tree = f["tree"].to_numpy()
        if not len(tree):
            continue
        new = np.concatenate(([last is None or tree[0] != last], tree[1:] != tree[:-1]))
        runs = run + np.cumsum(new)
        starts = np.flatnonzero(new)
        begin = np.zeros(len(tree), dtype=_I)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin)
        pos = np.arange(len(tree)) - begin
        pos[runs == run] += at
        run, last, at = int(runs[-1]), tree[-1], int(pos[-1]) + 1
        yield f.assign(part=part, run=runs, pos=pos)


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (tree, ...) with idx: 0, 1, ... by ``order`` within each tree."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", part int, run long, pos long"
    placed = keep(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInPandas(
        _runs, schema), name)
    runs = placed.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.first("tree").alias("tree"))
    ends = runs.groupBy("part").agg(F.max("run").alias("last"), F.min_by("tree", "run").alias("first_tree"),
                                    F.max_by("tree", "run").alias("last_tree"), F.max_by("n", "run").alias("n"))
    starts, open_tree, size = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        before = size if r["first_tree"] == open_tree else 0
        starts.append((r["part"], before))
        # the tree that is open at the end of this partition, and its nodes up to here
        size = r["n"] + (before if r["last"] == 0 else 0)
        open_tree = r["last_tree"]
    offsets = nodes.sparkSession.createDataFrame(starts, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").select(
        *nodes.columns, (F.col("pos") + F.when(F.col("run") == 0, F.col("before")).otherwise(0)).alias("idx"))


def _height(n: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // 3), k + 1
    return k


def block_paths(sizes: np.ndarray, later: np.ndarray, digest: np.ndarray, height: int):
    """Blocks laid end to end. ``sizes``: nodes of each block; ``later``: it is not
    its tree's first block. Returns (block digests, path entries nodes x height x
    ENTRY, number of levels of each block)."""
    blocks = len(sizes)
    levels = np.array([height if late else _height(n) for n, late in zip(sizes.tolist(), later.tolist())], dtype=_I)
    n = int(sizes.sum())
    paths = np.zeros((n, height, ENTRY), dtype=np.uint8)
    top = np.zeros((blocks, 32), dtype=np.uint8)
    of = np.repeat(np.arange(blocks), sizes)
    pos = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    above = np.arange(n)  # the node of the present level that a leaf is under (-1: block done)
    for level in range(height + 1):
        done = levels[of] == level
        if done.any():
            top[of[done]] = digest[done]
            go = ~done
            renumber = np.cumsum(go) - 1
            held = above >= 0
            above[held] = np.where(done[above[held]], -1, renumber[above[held]])
            of, pos, digest = of[go], pos[go], digest[go]
        if not len(of):
            break
        first = np.flatnonzero(pos % 3 == 0)  # a parent's first child
        kids = np.diff(np.concatenate((first, [len(pos)])))
        parent = np.repeat(np.arange(len(first)), kids)
        # the states a parent keeps: before each slot
        states = np.zeros((len(first), 4, 8), dtype=np.uint32)
        states[:, 0] = M.START
        made = np.empty((len(first), 32), dtype=np.uint8)
        for k in range(3):
            has = np.flatnonzero(kids > k)
            states[has, k + 1] = M.take_digest(states[has, k], digest[first[has] + k])
            full = np.flatnonzero(kids == k + 1)
            made[full] = M.close(states[full, k + 1], k + 1)
        slot = pos % 3
        entry = np.zeros((len(pos), ENTRY), dtype=np.uint8)
        entry[:, 0], entry[:, 1] = slot, kids[parent]
        entry[:, 2:34] = np.ascontiguousarray(states[parent, slot].astype(">u4")).view(np.uint8).reshape(-1, 32)
        at = np.zeros(len(pos), dtype=_I)
        for k in range(3):
            other = np.flatnonzero((slot != k) & (kids[parent] > k))
            rows = first[parent[other]] + k
            for j in (0, 1):
                mine = at[other] == j
                entry[other[mine], 34 + 32 * j:66 + 32 * j] = digest[rows[mine]]
            at[other] += 1
        held = np.flatnonzero(above >= 0)
        paths[held, level] = entry[above[held]]
        above[held] = parent[above[held]]
        of, pos, digest = of[first], pos[first] // 3, made
    return top, paths, levels


def _climb(height: int):
    """Of rows (tree, block, idx, digest, ...) sorted by the first three: each with its
    path within the block, the block's digest and the number of its levels."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        tree, block = f["tree"].to_numpy(), f["block"].to_numpy()
        new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(f)])))
        digest = np.frombuffer(b"".join(f["digest"]), dtype=np.uint8).reshape(-1, 32)
        top, paths, levels = block_paths(sizes, block[starts] > 0, digest, height)
        tops, by = [x.tobytes() for x in top], np.repeat(np.arange(len(starts)), sizes)
        return f.assign(path=[p[:k].tobytes() for p, k in zip(paths, levels[by].tolist())],
                        top=[tops[k] for k in by.tolist()])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) < BATCH:
                continue
            f = pd.concat(held, ignore_index=True)
            tree, block = f["tree"].to_numpy(), f["block"].to_numpy()
            open_ = (tree == tree[-1]) & (block == block[-1])
            cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            for a, b in _slices(tree[:cut], block[:cut]):
                yield work(f.iloc[a:b])
            held = [f.iloc[cut:]]
        f = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(f):
            for a, b in _slices(f["tree"].to_numpy(), f["block"].to_numpy()):
                yield work(f.iloc[a:b])

    return scan


def _slices(tree: np.ndarray, block: np.ndarray):
    """Slices of whole blocks with about BATCH rows."""
    if not len(tree):
        return
    ends = np.concatenate((np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1, [len(tree)]))
    start = 0
    for i, end in enumerate(ends):
        if i + 1 == len(ends) or ends[i + 1] - start > BATCH:
            yield start, int(end)
            start = int(end)


def climb(nodes: DataFrame, height: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes``: tree, idx, digest and more. Returns the nodes with their block and
    ``path`` within it; the blocks (tree, block, rest: path from there to the
    tree's root); and the roots (tree, digest)."""
    size = 3**height
    level, climbs = nodes.withColumn("block", F.floor(F.col("idx") / size).cast("long")), []
    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema) + ", path binary, top binary"
        done = keep(level.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInPandas(
            _climb(height), schema), name)
        climbs.append(done)
        blocks = done.groupBy("tree", "block").agg(F.first("top").alias("digest"))
        if done.agg(F.max("block")).first()[0] in (0, None):
            break
        level = blocks.select("tree", F.col("block").alias("idx"), "digest",
                              F.floor(F.col("block") / size).cast("long").alias("block"))
    rest = blocks.select("tree", "block", F.lit(b"").alias("rest"))
    for done in reversed(climbs[1:]):
        rest = done.join(rest, ["tree", "block"]).select(
            "tree", F.col("idx").alias("block"), F.concat("path", "rest").alias("rest"))
    return climbs[0], rest, blocks.select("tree", "digest")


def fold(digest: np.ndarray, paths: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The root digests that leaf digests (n x 32) lead to by their paths."""
    now = digest.copy()
    for k in range(paths.shape[1]):
        rows = np.flatnonzero(levels > k)
        entry = paths[rows, k]
        slot, kids = entry[:, 0], entry[:, 1]
        state = np.ascontiguousarray(entry[:, 2:34]).view(">u4").astype(np.uint32)
        state = M.take_digest(state, now[rows])
        for j in (0, 1):  # right siblings
            right = np.flatnonzero(slot + 1 + j < kids)
            sibling = entry[right, 34:].reshape(-1, 2, 32)[np.arange(len(right)), slot[right] + j]
            state[right] = M.take_digest(state[right], sibling)
        for n in (1, 2, 3):
            full = np.flatnonzero(kids == n)
            now[rows[full]] = M.close(state[full], n)
    return now


def _proofs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for a in range(0, len(frame), 4096):
            f = frame.iloc[a:a + 4096]
            levels = np.array([len(p) // ENTRY for p in f["path"]], dtype=_I)
            paths = np.zeros((len(f), int(levels.max()), ENTRY), dtype=np.uint8)
            paths[np.arange(paths.shape[1]) < levels[:, None]] = np.frombuffer(
                b"".join(f["path"]), dtype=np.uint8).reshape(-1, ENTRY)
            leaf = np.frombuffer(b"".join(f["digest"]), dtype=np.uint8).reshape(-1, 32)
            given = np.frombuffer(b"".join(f["replacement"]), dtype=np.uint8).reshape(-1, 32)
            root = fold(given, paths, levels)
            # all siblings, left to right, level by level
            has = paths[:, :, 1, None].astype(int) - 1 > np.arange(2)
            text = paths[:, :, 34:].reshape(len(f), -1, 2, 32)[has].tobytes().hex()
            ends = (np.cumsum(has.sum(axis=(1, 2))) * 64).tolist()
            proof = [hashlib.sha256(text[x:y].encode()).hexdigest() for x, y in zip([0, *ends], ends)]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "leaf": [x.tobytes().hex() for x in leaf], "subroot": f["subroot"],
                "root": f["top_root"], "proof_sha256": proof,
                "folded_root": [x.tobytes().hex() for x in root], "path": f["path"]})


def manifest(documents: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified, and the path that folds a leaf to the root. ``tampered``: the text to
    fold instead of the original (none: the original)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")
    leaves = keep(spread(docs).select(
        "doc_id", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        leaf_digest(F.col("text")).alias("digest"),
        leaf_digest(F.col("text") if tampered is None else tampered).alias("replacement"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    nodes, rest, subroots = climb(numbered(leaves, ["doc_id", "digest", "row"], "placed").drop("row"), height, "paths")
    # the subroots are the nodes of one more tree
    named = keep(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest"), "subroots")
    ends, end_rest, root = climb(numbered(named, ["source_tree"], "top-placed"), height, "top-paths")
    first = root.select("digest").first()
    last = F.lit(None if first is None else bytes(first[0]).hex()).cast("string")
    ends = ends.join(end_rest, ["tree", "block"]).select(
        F.col("source_tree").alias("tree"), F.concat("path", "rest").alias("end"), F.lower(F.hex("digest")).alias("subroot"))
    # joined to blocks first, so that no leaves meet by source
    rest = rest.join(ends, "tree").select("tree", "block", F.concat("rest", "end").alias("rest"), "subroot")
    joined = nodes.join(rest, ["tree", "block"]).withColumn("path", F.concat("path", "rest")).withColumn("top_root", last)
    proved = joined.select("doc_id", "digest", "replacement", "path", "subroot", "top_root").mapInPandas(
        _proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                 "folded_root string, path binary")
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"), "path")


def tampered_text() -> Column:
    """Deletes line ends where 2 divides the id's crc32."""
    return F.when(remainder(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
