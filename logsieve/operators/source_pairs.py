"""D5 as a table: all pairs of distinct sources that pass the source gate.

The gate is ``1 - edits / longer > 0.7`` on lower-cased bytes, so a pair with a longer
side of L bytes may differ by at most ``t(L) = floor(0.3 L)`` edits. The join is on
segments, not on pairs:

- the shorter string (l bytes) is cut into t(L) + 1 pieces of nearly equal length. So
  many edits can't touch all of them: one piece is in the longer string unchanged;
- with at most t(L) edits in total, the i-th piece can have moved only a little. From
  the left at most i - 1 edits lie before it, from the right at most t(L) + 1 - i
  after it; both bound its place in the longer string.

Keys hold both lengths, the piece's number and its bytes. A key met by a pair is a
candidate; the built-in ``levenshtein`` with its bound decides. Pieces number about
a third of a source's bytes, for each length the other side may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import bytes_text, source_gate
from ..functions.text import pinned


def _edits(longer: Column) -> Column:
    """Most edits a pair may have whose longer side has so many bytes (not less)."""
    return F.floor(longer * F.lit(3) / F.lit(10)).cast("int")


def _piece_start(i: Column, size: Column, pieces: Column) -> Column:
    """0-based place of the i-th (from 1) of ``pieces`` pieces; the last ones are longer by 1."""
    short = F.floor(size / pieces).cast("int")
    n_short = pieces - size % pieces
    return (i - 1) * short + F.greatest(F.lit(0), i - 1 - n_short)


def _piece_size(i: Column, size: Column, pieces: Column) -> Column:
    short = F.floor(size / pieces).cast("int")
    return F.when(i > pieces - size % pieces, short + 1).otherwise(short)


def _key() -> Column:
    return F.xxhash64("size", "longer", "i", "piece")


def _pieces(strings: DataFrame) -> DataFrame:
    """The shorter side: its pieces, for every length the longer side may have."""
    sized = strings.withColumn("longer", F.explode(F.sequence(F.col("size"), F.floor(F.col("size") * 10 / 7).cast("int"))))
    cut = sized.withColumn("t", _edits(F.col("longer"))).where(F.col("longer") - F.col("size") <= F.col("t"))
    each = cut.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("t") + 1)))
    n = F.col("t") + 1
    return each.withColumn("piece", F.substring(
        F.col("s8"), _piece_start(F.col("i"), F.col("size"), n) + 1, _piece_size(F.col("i"), F.col("size"), n))).select(
        "source", _key().alias("key"))


def _places(strings: DataFrame) -> DataFrame:
    """The longer side: the substrings a piece of a shorter string may be found as."""
    t = _edits(F.col("longer"))
    sized = strings.withColumnRenamed("size", "longer").withColumn("t", t).withColumn(
        "size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("longer") - t), F.col("longer"))))
    each = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("t") + 1)))
    n, i, more = F.col("t") + 1, F.col("i"), F.col("longer") - F.col("size")
    each = pinned(each, start=_piece_start(i, F.col("size"), n), len=_piece_size(i, F.col("size"), n))
    start = F.col("start")
    low = F.greatest(F.lit(0), start - (i - 1), start + more - (F.col("t") + 1 - i))
    high = F.least(F.col("longer") - F.col("len"), start + (i - 1), start + more + (F.col("t") + 1 - i))
    ranged = pinned(each, low=low, high=high).where("low <= high")
    return ranged.withColumn("at", F.explode(F.sequence(F.col("low"), F.col("high")))).withColumn(
        "piece", F.substring(F.col("s8"), F.col("at") + 1, F.col("len"))).select("source", _key().alias("key"))


def source_pairs(entries: DataFrame) -> DataFrame:
    """``(a_source, b_source, edits)`` of all pairs a < b of distinct lower-cased,
    non-empty sources that pass D5. Null sources count as empty."""
    strings = entries.select(F.lower("source").alias("source")).where("source <> ''").distinct().withColumn(
        "s8", bytes_text(F.col("source"))).withColumn("size", F.length("s8"))
    pieces, places = _pieces(strings), _places(strings)
    # equal lengths meet in both roles; the order keeps one of them
    met = pieces.withColumnRenamed("source", "x").join(places.withColumnRenamed("source", "y"), "key").where("x <> y")
    pairs = met.select(F.least("x", "y").alias("a_source"), F.greatest("x", "y").alias("b_source")).distinct()
    a8, b8 = bytes_text(F.col("a_source")), bytes_text(F.col("b_source"))
    return pairs.where(source_gate(F.col("a_source"), F.col("b_source"))).select(
        "a_source", "b_source", F.levenshtein(a8, b8).alias("edits"))
