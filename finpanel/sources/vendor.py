"""Vendor text files: tab-separated UTF-16 with differing headers, and comma files with a byte-order mark.

The driver reads the first bytes of each file: they tell the encoding and the header. Plain files are then scanned once, in splits of any size that
begin at line ends; what the scan gives is stored, with the files whose text can't be trusted marked. Those, and compressed files, are decoded strictly in pieces of
whole lines, which tasks share. A file with a piece that can't be understood without the others is read by one task, to rows or to one reason why it can't be read. A file
enters with all its rows or not at all.
"""

from __future__ import annotations

import bz2
import codecs
import csv
import gzip
import io
import sys
import zlib
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel.session import materialize
from finpanel.sources.files import first_bytes

MARK, UNREADABLE = "\ufeff", "\ufffd"
HEAD_BYTES = 1 << 16
#: Pieces of an unpacked file are about PIECE_BYTES long, so that a batch of them stays small, and about PARSED_BYTES are parsed at once; what has no line end for LINE_BYTES is no text.
PARSED_BYTES, PIECE_BYTES, LINE_BYTES = 1 << 20, 1 << 12, 1 << 24
PACKED = {".gz": lambda raw: gzip.GzipFile(fileobj=raw), ".bz2": bz2.BZ2File}

# Tasks get these functions by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Head(NamedTuple):
    """What the first bytes of a file tell: its encoding and column names, or the reason why it is left out."""

    path: str
    encoding: str = ""
    names: tuple[str, ...] = ()
    reason: str = ""


def _packed(path: str) -> str | None:
    return next((end for end in PACKED if path.endswith(end)), None)


def _first_text_bytes(path: str, raw: bytes) -> bytes:
    if path.endswith(".gz"):
        return zlib.decompressobj(31).decompress(raw, HEAD_BYTES)
    return bz2.BZ2Decompressor().decompress(raw, HEAD_BYTES) if path.endswith(".bz2") else raw


def _why(err: Exception) -> str:
    for kind, reason in ((UnicodeError, "not in its encoding"), (EOFError, "cut off"), ((zlib.error, gzip.BadGzipFile), "damaged compression")):
        if isinstance(err, kind):
            return reason
    return f"unreadable: {type(err).__name__}"


def _encoding(raw: bytes, wanted: str) -> tuple[str, str] | None:
    """Encoding with a fixed byte order for ``wanted``, and the text of ``raw``; None if the file is not of that encoding."""
    if wanted == "UTF-16":  # needs a mark
        wanted = {codecs.BOM_UTF16_LE: "UTF-16LE", codecs.BOM_UTF16_BE: "UTF-16BE"}.get(raw[:2], "")
        if not wanted:
            return None
    return wanted, raw.decode(wanted, errors="ignore")


def _head(spark: SparkSession, path: str, keys: Sequence[str], sep: str, encodings: Sequence[str]) -> Head:
    try:
        raw = _first_text_bytes(path, first_bytes(spark, path, HEAD_BYTES))
    except (Py4JJavaError, zlib.error, OSError) as err:
        return Head(path, reason=_why(err))
    for wanted in encodings:
        found = _encoding(raw, wanted)
        for line in found[1].split("\n") if found else ():
            if all(k in line for k in keys):
                return Head(path, found[0], tuple(c.strip().strip('"').strip(MARK).strip() for c in line.rstrip("\r").split(sep)))
    return Head(path, reason="no header")


def _record(path: str, rows: list, error: str | None) -> pa.RecordBatch:
    kinds = (pa.string(), pa.list_(pa.string()), pa.string())
    columns = ([path] * len(rows), rows, [error] * len(rows))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "cells", "error"])


ROWS = "path string, cells array<string>, error string"


def _whole_lines(raw: bytes, end: bytes) -> tuple[list[bytes], bytes]:
    """``raw`` in pieces of whole lines, and what stands behind the last line end. A line end stands at a full character."""
    pieces, start = [], 0
    while True:
        at = raw.find(end, start + PIECE_BYTES)
        while at % len(end) and at >= 0:
            at = raw.find(end, at + 1)
        if at < 0:
            return pieces, raw[start:]
        pieces.append(raw[start : at + len(end)])
        start = at + len(end)


def _unpacked(encodings: Mapping[str, str]):
    """Rows path, content: compressed files in pieces of whole lines; a row without content for a file that can't be unpacked to its end or cut into lines."""

    def record(path: str, pieces: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], names=["path", "content"])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw, end, rest = PACKED[_packed(path)](io.BytesIO(memoryview(content.as_buffer()))), "\n".encode(encodings[path]), b""
                try:
                    while (more := raw.read(PARSED_BYTES)) and len(rest) < LINE_BYTES:
                        pieces, rest = _whole_lines(rest + more, end)
                        yield record(path, pieces)
                    yield record(path, [None] if more else [rest] if rest else [])
                except (EOFError, OSError, zlib.error):
                    yield record(path, [None])

    return run


def _strict_pieces(sep: str, files: Mapping[str, tuple[str, str]]):
    """Rows path, cells of pieces of whole lines; ``files`` has listed paths and encodings, by listed path of a compressed file and by plain path of a plain one.
    A row path, error tells that the file must be read as a whole: a piece can't be decoded by itself, or a cell goes on behind a line end."""

    def cells(pieces: list, encoding: str) -> list[list[str]]:
        end = "\n".encode(encoding)
        if any(p is None or len(p) % len(end) for p in pieces):  # of a character that looks like a line end, one half stands in the next piece
            raise ValueError
        text = b"".join(p if p.endswith(end) else p + end for p in pieces).decode(encoding)
        lines = csv.reader(chain(io.StringIO(text, newline=""), ["the end"]), delimiter=sep)
        rows = list(lines)
        if lines.line_num != len(rows):
            raise ValueError
        return rows[:-1]

    def portions(pieces):
        held, size = [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece or b"")
            if size >= PARSED_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for batch in batches:
            for found, rows in groupby(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()), itemgetter(0)):
                path, encoding = files.get(found) or files[_plain_url(found)]
                for pieces in portions(content for _, content in rows):
                    try:
                        yield _record(path, cells(pieces, encoding), None)
                    except (ValueError, csv.Error):
                        yield _record(path, [None], "not by lines")

    return run


def _strict(sep: str, encodings: Mapping[str, str]):
    """Rows path, cells of whole files, or one row path, error for a file that can't be decoded or unpacked to its end."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw, end = io.BytesIO(memoryview(content.as_buffer())), _packed(path)
                text = io.TextIOWrapper(PACKED[end](raw) if end else raw, encoding=encodings[path], newline="")
                rows = []
                try:
                    for cells in csv.reader(text, delimiter=sep):
                        rows.append(cells)
                        if len(rows) >= 5000:
                            yield _record(path, rows, None)
                            rows = []
                    yield _record(path, rows, None)
                except (EOFError, OSError, UnicodeError, csv.Error, zlib.error) as err:
                    yield _record(path, [None], _why(err))

    return run


def _cells_of(rows: DataFrame, cells: Sequence[Column], names: Sequence[str], key: str, columns: Sequence[str] | None, *more: Column) -> DataFrame:
    """Named, trimmed cells; header lines are left out."""
    wanted = [n for n in names if n and (columns is None or n in columns)]
    named = [F.btrim(F.replace(cells[names.index(n)], F.lit(MARK), F.lit("")), F.lit(" \r")).alias(n) for n in wanted]
    found = rows.select(*named, *more)
    return found.where(F.coalesce(F.col(f"`{key}`") != key, F.lit(True)))


def _scan(spark: SparkSession, names: Sequence[str], files: list[str], sep: str, encoding: str, key: str, columns: Sequence[str] | None) -> DataFrame:
    """One scan over plain files of one header and encoding, in splits. Lines end with a line feed, so a quoted cell can't hold one.

    Bytes that look like a line end across two characters, or that are no text, leave a replacement character behind: ``_odd`` marks such rows.
    """
    slots = [f"_c{i}" for i in range(len(names))]
    raw = (
        spark.read.schema(", ".join(f"{s} string" for s in slots))
        .options(sep=sep, encoding=encoding, lineSep="\n", ignoreCorruptFiles=False)
        .csv(files)
    )
    odd = F.contains(F.concat_ws("", *slots), F.lit(UNREADABLE))
    return _cells_of(raw, [F.col(s) for s in slots], names, key, columns, F.col("_metadata.file_name").alias("_src"), F.col("_metadata.file_path").alias("_path"), odd.alias("_odd"))


def _read_pieces(spark: SparkSession, heads: list[Head], sep: str) -> DataFrame:
    """Files in pieces of whole lines: Spark cuts plain ones into lines, and one task unpacks a compressed one for all."""
    packed, parts = [h for h in heads if _packed(h.path)], []
    for encoding in sorted({h.encoding for h in heads if not _packed(h.path)}):
        lines = spark.read.options(lineSep="\n", encoding=encoding).text([h.path for h in heads if h.encoding == encoding and not _packed(h.path)])
        parts.append(lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content")))
    if packed:
        content = spark.read.format("binaryFile").load([h.path for h in packed]).select("path", "content")
        parts.append(materialize(content.mapInArrow(_unpacked({h.path: h.encoding for h in packed}), "path string, content binary"), "unpacked"))
    files = {h.path if _packed(h.path) else _plain(h.path): (h.path, h.encoding) for h in heads}
    return reduce(lambda a, b: a.union(b), parts).mapInArrow(_strict_pieces(sep, files), ROWS)


def _read_strictly(spark: SparkSession, heads: list[Head], sep: str, key: str, columns: Sequence[str] | None) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Rows of files that are decoded strictly, by header, and (path, reason) of the broken ones: in pieces, and those where that does not do one by one."""

    def named(found: DataFrame, good: list[Head]) -> list[DataFrame]:
        out = []
        for names in sorted({h.names for h in good}):
            rows = found.where(F.col("path").isin([h.path for h in good if h.names == names]))
            out.append(_cells_of(rows, [F.get("cells", i) for i in range(len(names))], names, key, columns, F.element_at(F.split("path", "/"), -1).alias("_src")))
        return out

    if not heads:
        return [], []
    found, broken = materialize(_read_pieces(spark, heads, sep), "pieces"), {}
    whole = {r["path"] for r in found.where("error IS NOT NULL").select("path").distinct().collect()}  # at most one row per file
    out = named(found, [h for h in heads if h.path not in whole])
    if left := [h for h in heads if h.path in whole]:
        content = spark.read.format("binaryFile").load([h.path for h in left]).select("path", "content")
        found = materialize(content.mapInArrow(_strict(sep, {h.path: h.encoding for h in left}), ROWS), "files")
        broken = {r["path"]: r["error"] for r in found.where("error IS NOT NULL").collect()}  # one row per broken file
        out += named(found, [h for h in left if h.path not in broken])
    return out, sorted(broken.items())


def read_files(
    spark: SparkSession, paths: Sequence[str], *, keys: Sequence[str], sep: str, encodings: Sequence[str], columns: Sequence[str] | None = None,
) -> tuple[DataFrame | None, DataFrame, list[Head]]:
    """(rows or None, skipped, heads): rows of all readable files, united by column name, with ``_src``; path and reason of the others.

    The driver holds one header per file, no more than the listing itself.
    """
    listed = [r["path"] for r in spark.read.format("binaryFile").load(list(paths)).select("path").collect()]  # the content column is not read
    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(lambda p: _head(spark, p, keys, sep, encodings), listed))
    skipped = [(h.path, h.reason) for h in heads if h.reason]
    plain = [h for h in heads if not h.reason and not _packed(h.path)]
    strict = [h for h in heads if not h.reason and _packed(h.path)]
    key, parts = keys[0], []
    layouts = sorted({(h.names, h.encoding) for h in plain})
    scans = [_scan(spark, names, sorted(h.path for h in plain if (h.names, h.encoding) == (names, enc)), sep, enc, key, columns) for names, enc in layouts]
    if scans:
        stored = materialize(_united(scans), "vendor")
        odd = [r["_path"] for r in stored.where("_odd").select("_path").distinct().collect()]  # at most one row per file
        again = {_plain_url(p) for p in odd}
        strict += [h for h in plain if _plain(h.path) in again]
        parts.append((stored.where(~F.col("_path").isin(odd)) if odd else stored).drop("_path", "_odd"))
    more, broken = _read_strictly(spark, strict, sep, key, columns)
    parts += more
    return _united(parts) if parts else None, spark.createDataFrame(sorted([*skipped, *broken]), "path string, reason string"), heads


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _plain(path: str) -> str:
    """A listed path without its scheme."""
    return "/" + path.split(":", 1)[-1].lstrip("/")


def _plain_url(path: str) -> str:
    """The same out of the path's URL form."""
    return unquote(_plain(path))


def read_vendor(
    spark: SparkSession,
    paths: Sequence[str] | str,
    *,
    key: str,
    columns: Sequence[str] | None = None,
    sep: str = "\t",
    encodings: Sequence[str] = ("UTF-16", "UTF-16LE"),
) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of text files, all cells as trimmed strings, united by column *name*; skipped has path and reason.

    Every file is read by its own header line, the first one with ``key`` in it, which must stand in the first 64 KB. A file without it is tried in the
    next encoding (UTF-16 without a mark), then skipped. A file that can't be decoded or unpacked to its end gives no row. With ``columns`` only
    those are kept, where a file has them. ``_src`` is the file name. Rows are stored in the shared folder; a cell must not hold a line feed
    unless its file is compressed.
    """
    rows, skipped, _ = read_files(spark, [paths] if isinstance(paths, str) else paths, keys=[key], sep=sep, encodings=encodings, columns=columns)
    if rows is None:
        raise ValueError(f"no readable file with a column {key!r}")
    return rows, skipped


def read_bom_csv(spark: SparkSession, path: str | Sequence[str], *, required: Sequence[str]) -> DataFrame:
    """Comma files in UTF-8 with an optional mark, all cells as strings, united by column name; ``_src`` is the file name.

    Every file is read by its own header, so files may order their columns differently; one that lacks a required column raises, and so does one that can't be
    read to its end. Empty files are passed over.
    """
    paths = [path] if isinstance(path, str) else list(path)
    filled = [r["path"] for r in spark.read.format("binaryFile").load(paths).where("length > 0").select("path").collect()]
    if not filled:
        raise ValueError(f"missing columns: {sorted(required)}")
    rows, skipped, heads = read_files(spark, filled, keys=list(required)[:1], sep=",", encodings=["UTF-8"])
    missing = sorted({c for h in heads for c in set(required) - set(h.names) if h.names or h.reason == "no header"})
    if missing:
        raise ValueError(f"missing columns: {missing}")
    broken = sorted(r["path"] for r in skipped.collect())
    if broken:
        raise ValueError(f"files that can't be read: {broken}")
    return rows


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns that exist, under their new names."""
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in mapping.items() if k in df.columns])


def rename_legacy(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename former column names where present and the new name is still free."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def overflow_map(df: DataFrame, keep: Sequence[str], ignore: Sequence[str] = (), *, number) -> Column:
    """Map of all columns outside ``keep`` and ``ignore`` to cleaned numbers, nulls left out, null if empty."""
    rest = [c for c in df.columns if c not in keep and c not in ignore and not c.startswith("_")]
    if not rest:
        return F.lit(None).cast("map<string,double>")
    names = F.array(*[F.lit(c) for c in rest])
    values = F.array(*[number(F.col(f"`{c}`")) for c in rest])
    filled = F.map_filter(F.map_from_arrays(names, values), lambda _, v: v.isNotNull())
    return F.when(F.size(filled) > 0, filled)


def kpi_view(df: DataFrame, items: Mapping[str, str], *, data: str = "data", keep: Sequence[str] = ("security_code", "season")) -> DataFrame:
    """Named key figures out of an item map: one column per entry of ``items`` (column -> item)."""
    return df.select(*keep, *[F.try_element_at(F.col(data), F.lit(item)).alias(name) for name, item in items.items()])
