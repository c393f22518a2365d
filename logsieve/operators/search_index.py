"""F5 on a large staged table: files that cannot hold a search term are not read.

Each Parquet file of the table gets a trigram filter: the lower-cased trigrams of its
messages, sources and extras texts, hashed into a bitmap of ``BITS`` bits (built by Spark's
bitmap aggregates, so a file's bitmap is made by partial aggregation and its size does not
depend on the file's). A term can only be in a file whose bitmap has the bits of all of
the term's trigrams. A bit may be set by another trigram, so a file may be read in vain;
no file that holds the term is skipped. Terms below three characters read all files.

The file names that are left become a predicate on the scan's own file path, which Spark
applies while it lists files; then F5 itself decides row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extras_text
from ..session import written
from .filters import apply_filters

#: Bits of a file's filter: 8 bitmaps of Spark's fixed size.
BITS = 8 * 32_768


def _position(trigram: Column) -> Column:
    """A trigram's bit, from 1 on."""
    return F.pmod(F.xxhash64(trigram), F.lit(BITS)) + 1


def _trigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.transform(
        F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(
        F.array().cast("array<string>"))


def build_index(table: DataFrame) -> DataFrame:
    """``(file, bucket, bitmap)`` of every file of a table of entries read from Parquet."""
    texts = table.select(F.col("_metadata.file_path").alias("file"), F.array(
        F.lower("message"), F.lower("source"), F.lower(extras_text(F.col("extras")))).alias("texts"))
    grams = texts.select("file", F.explode(F.array_distinct(F.flatten(F.transform("texts", _trigrams)))).alias("gram"))
    # each bit once: a hash aggregate as large as the bitmaps, so the bitmaps' sort gets few rows
    bits = grams.select("file", _position(F.col("gram")).alias("bit")).distinct()
    return written(bits.groupBy("file", F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")), "search-index")


def candidate_files(index: DataFrame, term: str) -> DataFrame:
    """The files (``file``) that may hold the term, of three characters or more."""
    low = term.lower()
    grams = sorted({low[i:i + 3] for i in range(len(low) - 2)})
    wanted = index.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(
        _position(F.col("gram")).alias("bit")).distinct().select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").cast("int").alias("at"))
    n = len({tuple(r) for r in wanted.collect()})
    byte = F.conv(F.hex(F.expr("substring(bitmap, at div 8 + 1, 1)")), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2), F.col("at") % 8)) % 2) == 1
    return index.join(F.broadcast(wanted), "bucket").where(hit).groupBy("file").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("file")


def search(table: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """The entries of ``table`` that F5 keeps, from the candidate files only. File names
    are metadata: one for each file that is read."""
    if len(term) < 3:
        return apply_filters(table, search_term=term)
    files = [r["file"] for r in candidate_files(index, term).collect()]
    return apply_filters(table.where(F.col("_metadata.file_path").isin(files)), search_term=term)
