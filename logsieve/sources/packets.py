"""Support-packet zips.

1. *Members.* ``binaryFile`` lists the packets (a glob or folder of many packets is one
   scan); any table of (path, content) will do as well. A packet's central directory is
   read once, and each member that holds logs (S5) becomes a row with its bytes as
   they are in the packet, still compressed.
2. *Lines.* The rows are dealt over the cluster by packet and member, so the members of one
   large packet are unpacked side by side. Each member is decompressed once, as a stream:
   its lines leave in batches bounded by lines and bytes, and a last row says how many they
   were or what went wrong (checksum, length, damaged data).
3. A member that can't be extracted is left out whole, like the original does: the lines
   and last rows are written once, and the few broken members are taken out by a join.

A packet is one binary row, so a single packet must stay under Spark's 2 GB row limit.
"""

from __future__ import annotations

import bz2
import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_lines
from ..operators.filters import apply_filters
from ..schema import MAX_LINE_BYTES, PACKET_MEMBER_FRAGMENTS, PACKET_MEMBER_SUFFIXES
from ..session import written

MEMBERS_DDL = ("packet_path string, member_idx int, member string, method int, crc bigint, size bigint, "
               "data binary, problem string")
LINES_DDL = "packet_path string, member_idx int, member string, line_no bigint, value string, end boolean, problem string"
_BATCH_LINES, _BATCH_BYTES = 8192, 4 << 20

# --- fixed values: problems as they are reported ---------------------------------
NOT_A_ZIP = "not a zip archive"
BROKEN_MEMBER = "member cannot be extracted"


def is_log_member(name: str) -> bool:
    """S5 on a member name."""
    return name.endswith(PACKET_MEMBER_SUFFIXES) or any(f in name for f in PACKET_MEMBER_FRAGMENTS)


def _stored(content: bytes, info: zipfile.ZipInfo) -> bytes | None:
    """A member's bytes as they lie in the packet; None if they can't be there."""
    at = info.header_offset
    if info.flag_bits & 1 or at < 0 or content[at:at + 4] != b"PK\x03\x04":  # encrypted, or no local header
        return None
    start = at + 30 + int.from_bytes(content[at + 26:at + 28], "little") + int.from_bytes(content[at + 28:at + 30], "little")
    data = content[start:start + info.compress_size]
    return data if len(data) == info.compress_size else None


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["packet_path", "member_idx", "member", "method", "crc", "size", "data", "problem"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                infos = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                yield pd.DataFrame([(path, None, None, None, None, None, None, NOT_A_ZIP)], columns=columns)
                continue
            for idx, info in enumerate(m for m in infos if not m.is_dir()):
                if is_log_member(info.filename):
                    data = _stored(content, info)
                    yield pd.DataFrame([(path, idx, info.filename, info.compress_type, info.CRC, info.file_size, data,
                                         None if data is not None else BROKEN_MEMBER)], columns=columns)


def _unpacked(data: bytes, method: int) -> Iterator[bytes]:
    """The member's bytes, piece by piece of bounded size."""
    if method == zipfile.ZIP_STORED:
        yield from (data[k:k + (1 << 20)] for k in range(0, len(data), 1 << 20))
    elif method == zipfile.ZIP_DEFLATED:
        stream = zlib.decompressobj(-15)
        rest = data
        while not stream.eof:
            piece = stream.decompress(rest, 1 << 20)
            rest = stream.unconsumed_tail
            if not piece and not rest and not stream.eof:
                raise EOFError("cut short")
            yield piece
    elif method == zipfile.ZIP_BZIP2:
        with bz2.BZ2File(io.BytesIO(data)) as fh:
            yield from iter(lambda: fh.read(1 << 20), b"")
    elif method == zipfile.ZIP_LZMA:  # a header of 4 bytes, then the filter's properties
        size = int.from_bytes(data[2:4], "little")
        props = lzma._decode_filter_properties(lzma.FILTER_LZMA1, data[4:4 + size])
        stream = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[props])
        rest = data[4 + size:]
        while not stream.eof:
            piece = stream.decompress(rest, 1 << 20)
            if not piece and stream.needs_input:
                break
            rest = b""
            yield piece
    else:
        raise NotImplementedError(f"compression method {method}")


class _Checked(io.RawIOBase):
    """A member as a readable stream that knows whether it was whole."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest, self.crc, self.size = pieces, b"", 0, 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.crc, self.size, self.rest = zlib.crc32(piece, self.crc), self.size + len(piece), piece
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _text_lines(fh) -> Iterator[str]:
    """Lines of a member. Of a line that is too long only so much is kept that
    the parser sees it is; the rest is read past."""
    while raw := fh.readline(MAX_LINE_BYTES + 1):
        whole = raw.endswith(b"\n")
        if not whole and len(raw) > MAX_LINE_BYTES:
            while (more := fh.readline(1 << 20)) and not more.endswith(b"\n"):
                pass
        text = raw[:-1] if whole else raw
        yield (text[:-1] if text.endswith(b"\r") else text).decode("utf-8", "replace")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, idx, member, method, crc, size, data, problem in pdf.itertuples(index=False, name=None):
            where = (path, None if pd.isna(idx) else int(idx), member)
            if problem is not None:
                yield _frame(where, 0, [None], True, problem)
                continue
            buf: list[str] = []
            start = held = 0
            try:
                stream = _Checked(_unpacked(data, int(method)))
                for line in _text_lines(io.BufferedReader(stream, 1 << 16)):
                    buf.append(line)
                    held += len(line)
                    if len(buf) >= _BATCH_LINES or held >= _BATCH_BYTES:
                        yield _frame(where, start, buf)
                        start, held, buf = start + len(buf), 0, []
                whole = stream.crc == int(crc) and stream.size == int(size)
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, NotImplementedError):
                whole = False
            if buf and whole:
                yield _frame(where, start, buf)
            yield _frame(where, start + len(buf), [None], True, None if whole else BROKEN_MEMBER)


def _frame(where: tuple, start: int, lines: list, end: bool = False, problem: str | None = None) -> pd.DataFrame:
    n = len(lines)
    path, idx, member = where
    return pd.DataFrame({
        "packet_path": path, "member_idx": pd.array([idx] * n, "Int32"), "member": [member] * n,
        "line_no": range(start, start + n), "value": lines, "end": end, "problem": [problem] * n,
    })


class Packets:
    """The lines of packets, unpacked once: ``lines`` of whole members, ``status`` of all."""

    def __init__(self, spark: SparkSession, packets: str | list[str] | DataFrame):
        if not isinstance(packets, DataFrame):
            paths = [packets] if isinstance(packets, str) else list(packets)
            packets = spark.read.format("binaryFile").load(paths)
        members = packets.select("path", "content").mapInPandas(_members, MEMBERS_DDL)
        self.rows = written(members.repartition("packet_path", "member_idx").mapInPandas(_lines, LINES_DDL), "packet-lines")

    def status(self) -> DataFrame:
        """One row per packet and log member: lines, and the problem if it could not
        be read (member null: the packet itself)."""
        return self.rows.where("end").select(
            "packet_path", "member_idx", "member",
            F.when(F.col("problem").isNull(), F.col("line_no")).otherwise(0).alias("lines"), "problem")

    def lines(self) -> DataFrame:
        """``(packet_path, member_idx, member, line_no, value)`` of the whole members."""
        broken = self.rows.where("end and problem is not null and member is not null").select("packet_path", "member_idx")
        return self.rows.where("not end").join(broken, ["packet_path", "member_idx"], "left_anti").drop("end", "problem")

    def entries(self, **filters: str) -> DataFrame:
        """Parsed, filtered entries of every whole log member, in zip then line order
        (``ord`` = packet, member index, line number); no time sort."""
        lines = self.lines().select(
            F.col("packet_path").alias("file_path"),
            F.struct(
                F.lit(0).cast("bigint").alias("f"),
                F.col("packet_path").alias("n"),
                F.col("member_idx").cast("bigint").alias("p"),
                F.col("line_no").alias("s"),
            ).alias("ord"),
            "member",
            "value",
        )
        parsed = parse_lines(lines)
        return apply_filters(parsed.where(F.col("parse_error").isNull()).drop("parse_error"), **filters)


def packet_status(spark: SparkSession, packets: str | list[str] | DataFrame) -> DataFrame:
    return Packets(spark, packets).status()


def packet_entries(spark: SparkSession, packets: str | list[str] | DataFrame, **filters: str) -> DataFrame:
    """S4. ``packets``: paths, or a table of (path, content). A path that is no zip raises;
    members that can't be extracted are left out and listed by ``packet_status``."""
    opened = Packets(spark, packets)
    bad = opened.rows.where("end and member is null").select("packet_path").take(1)
    if bad:
        raise ValueError(f"'{bad[0][0]}' is not a zip archive (packet_status lists all)")
    return opened.entries(**filters)
