"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a word target; a document of a source should be taken
target / source_size times, a fractional number of copies in [0, 2]. The whole
part is taken at once. The fraction, as a mass of words between 0 and the
document's size, is rounded with the pivotal method: two documents meet, mass
moves at random from one to the other (in expectation nothing moves) until one
of them holds nothing or all of its words, and the other one goes on. Moves keep
the sum of words, so a source ends within one document of its target.

The meetings form a reduction tree: documents fall into small blocks of one
source, a block folds to at most one undecided document, those fall into blocks
again, and so on; the last one of a source is rounded alone. Every block is
bounded by ``block`` rows (about, at the first level, where a hash deals them
out), however large its source is. All random numbers are hashes of whole rows
(with a number for equal rows) and a seed, so reruns agree and rows that share an
id are rounded apart.

Only DataFrame / SQL expressions are used. Defined results: a null or empty
text has size 0 and takes 0 words; the null source is a source of its own and
comes last; repeated rows are rounded one by one; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import numbered
from .common import keep

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SEED = 20231

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, n (rows with words), target.

    Water filling: target = min(most * size, level * weight) with the level that
    makes the targets add up to ``share`` of all words. Sources are numbered by
    range partitions. The level starts as if no source had a cap and rises with
    the sums over the sources it has not filled, until it fills no more.
    """
    by = keep(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n")), "mix-sources")
    by = numbered(by.withColumn("node", F.struct(F.col("source").isNull().alias("none"), "source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("seq") % len(weights) + 1).cast("int"))
    by = keep(by.select("source", "source_size", "n", w.alias("w"),
                        (F.col("source_size") * float(most)).alias("cap")), "mix-weights")
    words = by.agg(F.sum("source_size")).first()[0] or 0
    level, full = -1.0, -1
    while True:
        filled = F.col("cap") <= F.lit(level) * F.col("w")
        r = by.agg(F.count(F.when(filled, 1)), F.sum(F.when(filled, F.col("cap"))),
                   F.sum(F.when(~filled, F.col("w")))).first()
        if r[0] <= full or r[2] is None:
            break
        full, level = r[0], (words * float(share) - (r[1] or 0.0)) / r[2]
    target = F.col("cap") if r[2] is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return by.select("source", "source_size", "n", target.alias("target"))


# One meeting of the fold below. r: the undecided document so far (null: none),
# x: the next one; id, s (words), a (mass), h (its random number, 0 to 1).
# up / down: how much x can give to r, and r to x.
_MEET = """
CASE WHEN st.r IS NULL THEN struct(x as r, st.done as done)
ELSE transform(array(struct(least(x.a, st.r.s - st.r.a) as up, least(st.r.a, x.s - x.a) as down)), m ->
  CASE WHEN pmod(xxhash64({seed}, st.r.h, x.h), 1048576) / 1048576D * (m.up + m.down) < m.down
  THEN transform(array(struct(
         IF(m.up >= st.r.s - st.r.a, st.r.s, st.r.a + m.up) as ra, IF(m.up >= x.a, 0D, x.a - m.up) as xa)), z -> {settle})[0]
  ELSE transform(array(struct(
         IF(m.down >= st.r.a, 0D, st.r.a - m.down) as ra, IF(m.down >= x.s - x.a, x.s, x.a + m.down) as xa)), z -> {settle})[0]
  END)[0]
END
"""
_SETTLE = """
struct(
  CASE WHEN z.ra > 0 AND z.ra < st.r.s THEN named_struct('h', st.r.h, 'id', st.r.id, 's', st.r.s, 'a', z.ra, 'row', st.r.row, 'key', st.r.key)
       WHEN z.xa > 0 AND z.xa < x.s THEN named_struct('h', x.h, 'id', x.id, 's', x.s, 'a', z.xa, 'row', x.row, 'key', x.key) END as r,
  concat(st.done,
         IF(z.ra > 0 AND z.ra < st.r.s, array(), array(named_struct('id', st.r.id, 's', st.r.s, 'more', IF(z.ra > 0, 1, 0), 'row', st.r.row, 'key', st.r.key))),
         IF(z.xa > 0 AND z.xa < x.s, array(), array(named_struct('id', x.id, 's', x.s, 'more', IF(z.xa > 0, 1, 0), 'row', x.row, 'key', x.key)))) as done)
"""
_ITEM = "struct<h:bigint,id:bigint,s:double,a:double,row:int,key:string>"
_DONE = "array<struct<id:bigint,s:double,more:int,row:int,key:string>>"
# equal rows numbered at once
RUN = 4096


def _fold(seed: int) -> str:
    meet = _MEET.format(seed=seed, settle=_SETTLE)
    start = f"struct(cast(null as {_ITEM}) as r, cast(array() as {_DONE}) as done)"
    return f"aggregate(items, {start}, (st, x) -> cast({meet} as struct<r:{_ITEM},done:{_DONE}>))"


def _single_rows(sizes: DataFrame) -> DataFrame:
    """One row for each row of ``sizes`` (doc_id, source, size, key), with nth (0,
    1, ...) among the equal ones. They are counted and dealt out again by runs, so
    no task meets all rows of an id."""
    run = (sizes.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("k"))
           .withColumn("at", F.explode(F.expr(f"sequence(0L, k - 1, {RUN}L)")))
           .repartition("doc_id", "source", "size", "key", "at"))
    return run.select("doc_id", "source", "size", "key",
                      F.explode(F.expr(f"sequence(at, least(at + {RUN}, k) - 1)")).alias("nth"))


def _row_copies(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
           block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``copies`` with the rows' key; ``sizes`` has it too."""
    sizes = sizes.select(F.col("doc_id").cast("long"), F.col("source"), F.col("size").cast("long"), F.col("key"))
    sizes = keep(_single_rows(sizes), "mix-sizes")
    goals = keep(targets(sizes, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    g = goals.select(F.col("source").alias("src"), "source_size", "target", "n",
                     rate.alias("rate"), F.xxhash64("source").alias("sk"))
    base = sizes.join(g, sizes["source"].eqNullSafe(g["src"])).drop("src")
    whole = F.floor(F.col("rate")).cast("int")
    part = F.col("rate") - F.floor(F.col("rate"))
    base = base.withColumn("whole", whole).withColumn("mass", part * F.col("size"))
    open_ = (F.col("size") > 0) & (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    settled = [base.filter(~open_).select(
        "source", "doc_id", "size", "key", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))]
    number = F.xxhash64(F.lit(seed), "doc_id", F.col("source").isNull(), "source", "size", "key", "nth")
    n_blocks = F.ceil(F.col("n") / F.lit(block))
    level = base.filter(open_).select(
        "source", "whole", F.pmod(number, n_blocks).alias("block"),
        F.struct(number.alias("h"), F.col("doc_id").alias("id"), F.col("size").cast("double").alias("s"),
                 F.col("mass").alias("a"), F.col("whole").alias("row"), F.col("key")).alias("item"))
    most_rows = goals.agg(F.max("n")).first()[0] or 0
    n_levels = 1 + max(0, math.ceil(math.log(max(1, most_rows / block), block)))
    for k in range(n_levels + 1):
        folded = (level.groupBy("source", "block")
                  .agg(F.array_sort(F.collect_list("item")).alias("items"))
                  .select("source", "block", F.expr(_fold(seed + k)).alias("st")))
        folded = keep(folded, f"mix-level{k}")
        settled.append(folded.select("source", F.explode("st.done").alias("d")).select(
            "source", F.col("d.id").alias("doc_id"), F.col("d.s").cast("long").alias("size"), F.col("d.key").alias("key"),
            (F.col("d.row") + F.col("d.more")).alias("copies")))
        left = folded.filter("st.r is not null").select(
            "source", F.floor(F.col("block") / block).alias("block"), F.col("st.r").alias("item"))
        if k < n_levels:
            level = left
    # one document of a source is left: rounded on its own
    lone = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), F.col("item.h")), F.lit(1048576)) / 1048576.0
    settled.append(left.select(
        "source", F.col("item.id").alias("doc_id"), F.col("item.s").cast("long").alias("size"), F.col("item.key").alias("key"),
        (F.col("item.row") + (lone * F.col("item.s") < F.col("item.a")).cast("int")).alias("copies")))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    return (rows.join(g, rows["source"].eqNullSafe(g["src"]))
            .select("doc_id", "source", "size", "key", "source_size", "target", F.col("copies").cast("int").alias("copies")))


def copies(sizes: DataFrame, **options) -> DataFrame:
    """``sizes``: doc_id, source, size. Returns doc_id, source, size,
    source_size, target and copies (a whole number of at most ``most``)."""
    return _row_copies(sizes.select("doc_id", "source", "size", F.lit("").alias("key")), **options).drop("key")


def _key(documents: DataFrame) -> Column:
    """A digest of the whole row."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns])))


def document_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) and the row's key."""
    return documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key(documents).alias("key"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """``copies`` of the documents by the words of their texts, with taken (the
    words the mix takes from a document, repeats counted)."""
    found = _row_copies(document_sizes(documents), **options).drop("key")
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as it is taken, with
    copy_no (1, 2, ...)."""
    # equal rows are taken n times as often; names that no column of the input is likely to have
    taken = (_row_copies(document_sizes(documents), **options).filter("copies > 0")
             .groupBy(F.col("key").alias("__mix_key"), F.col("copies").alias("__mix_copies"))
             .agg(F.count(F.lit(1)).alias("__mix_n")))
    kept = [c for c in documents.columns if c != "copy_no"]
    own = documents.withColumn("__mix_key", _key(documents)).dropDuplicates(["__mix_key"])
    return (own.join(taken, "__mix_key")
            .withColumn("__mix_n", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_n")))
            .select(*kept, F.explode(F.sequence(F.lit(1), "__mix_copies")).alias("copy_no")))
