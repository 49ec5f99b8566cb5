"""Archives by byte ranges (S7-S9): the directory at a file's end becomes rows, and only entries that are asked for are read.

A task reads the end of a file and its directory in pieces; entries are rows that Spark filters by name and deals out, so
the entries of one large archive are read by many tasks. An entry is inflated in pieces, and ``elements`` gives its
elements one by one, so that no part has to fit in a cell.

Refused as a whole: files without a directory, 64-bit and divided archives, and those with an encrypted entry. An entry
that is neither stored nor deflated, or whose bytes, size or checksum are wrong, has an error of its own. Of entries of
one name the last counts.
"""

from __future__ import annotations

import codecs
import contextlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.config import dealt
from assay.sources.blocks import opened

PIECE = 1 << 20
ROWS_AT_ONCE, BYTES_AT_ONCE = 5000, 8 << 20
# The records of the format.
END, LOCATOR, HEAD, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, HEAD_SIZE, LOCAL_SIZE, COMMENT = 22, 20, 46, 30, 0xFFFF
STORED, DEFLATED = 0, 8


class Damaged(ValueError):
    """The archive or the entry cannot be read."""


def fetch(f, start: int, stop: int) -> bytes:
    f.seek(start)
    data = f.read(stop - start)
    if len(data) != stop - start:
        raise Damaged("truncated archive")
    return data


def end_record(f, length: int) -> tuple[int, int, int]:
    """Number of entries, and where the directory starts and stops. The end record's comment must reach the file's end."""
    first = max(0, length - END_SIZE - COMMENT)
    tail = fetch(f, first, length)
    at = tail.rfind(END)
    while at >= 0:
        if at + END_SIZE <= len(tail) and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise Damaged("no directory of an archive")
    disk, start_disk, here, count, size, start, _ = struct.unpack("<4H2LH", tail[at + 4 : at + END_SIZE])
    if tail[max(0, at - LOCATOR_SIZE) : at][:4] == LOCATOR or count == 0xFFFF or 0xFFFFFFFF in (size, start):
        raise Damaged("64-bit archive")
    if disk or start_disk or here != count:
        raise Damaged("divided archive")
    if start + size > first + at:
        raise Damaged("directory beyond the end record")
    return count, start, start + size


def heads(f, count: int, start: int, stop: int) -> Iterator[tuple]:
    """(name, method, crc, packed, size, offset) of the entries of a directory, which is read in pieces."""
    held, at = b"", 0
    for _ in range(count):
        for need in (HEAD_SIZE, None):
            if need is None:
                need = HEAD_SIZE + sum(struct.unpack("<3H", held[at + 28 : at + 34]))
            if len(held) - at < need:
                more = fetch(f, start, min(stop, start + max(PIECE, need)))
                held, at, start = held[at:] + more, 0, start + len(more)
            if len(held) < at + need or held[at : at + 4] != HEAD:
                raise Damaged("bad directory record")
        flags, method = struct.unpack("<2H", held[at + 8 : at + 12])
        crc, packed, size, name_size = struct.unpack("<3LH", held[at + 16 : at + 30])
        offset = int.from_bytes(held[at + 42 : at + 46], "little")
        if flags & 1:
            raise Damaged("encrypted archive")
        if 0xFFFFFFFF in (packed, size, offset):
            raise Damaged("64-bit archive")
        yield held[at + HEAD_SIZE : at + HEAD_SIZE + name_size].decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, crc, packed, size, offset
        at += need


def inflated(f, entry: dict) -> Iterator[bytes]:
    """The bytes of an entry in pieces; the size and the checksum are known at its end."""
    if entry["method"] not in (STORED, DEFLATED):
        raise Damaged("unknown compression")
    local = fetch(f, entry["offset"], entry["offset"] + LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise Damaged("bad entry record")
    at = entry["offset"] + LOCAL_SIZE + sum(struct.unpack("<2H", local[26:30]))
    stop, crc, size = at + entry["packed"], 0, 0
    engine = zlib.decompressobj(-15) if entry["method"] == DEFLATED else None
    try:
        while at < stop:
            data = fetch(f, at, min(stop, at + PIECE))
            at += len(data)
            while data:
                out = engine.decompress(data, PIECE) if engine else data
                data = engine.unconsumed_tail if engine else b""
                crc, size = zlib.crc32(out, crc), size + len(out)
                yield out
        if engine:
            out = engine.flush()
            crc, size = zlib.crc32(out, crc), size + len(out)
            yield out
    except zlib.error as e:
        raise Damaged(f"bad compressed data: {e}") from None
    if engine and not engine.eof or size != entry["size"] or crc != entry["crc"]:
        raise Damaged("size or checksum of the entry differs")


DIRECTORY = "path string, no long, name string, method int, crc long, packed long, size long, offset long, error string"


def _batched(rows: Iterator[dict], schema: pa.Schema, weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if len(held) >= ROWS_AT_ONCE or heavy >= BYTES_AT_ONCE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, heavy = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def directory(files: DataFrame) -> DataFrame:
    """A row per entry of files(path, length), in the directory's order; an archive that is refused has one row, with its error."""
    schema = _arrow(DIRECTORY)
    names = schema.names[2:-1]

    def listed(path: str, length: int) -> Iterator[dict]:
        with contextlib.closing(opened(path)) as f:
            try:
                place = end_record(f, length)
                for _ in heads(f, *place):  # judged as a whole before any row is given
                    pass
            except Damaged as e:
                yield {"path": path, "error": str(e)}
                return
            for no, head in enumerate(heads(f, *place), 1):
                yield {"path": path, "no": no, **dict(zip(names, head, strict=True))}

    def run(batches):
        rows = (row for b in batches for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in listed(path, length))
        yield from _batched(rows, schema)

    return dealt(files.select("path", F.col("length").cast("long").alias("length")), "path").mapInArrow(run, DIRECTORY)


def wanted(files: DataFrame, pattern: str = "") -> DataFrame:
    """The directory's rows whose names match, the last of each name, dealt out by path and number; and the archives' errors."""
    found = directory(files).filter(F.col("error").isNotNull() | F.col("name").rlike(pattern))
    last = F.row_number().over(Window.partitionBy("path", "name").orderBy(F.desc("no")))
    return dealt(found.withColumn("turn", last).filter("turn = 1").drop("turn"), "path", "no")


def _read(found: DataFrame, give, ddl: str, weight) -> DataFrame:
    """Rows of ``give(f, entry)`` for each entry. What an entry gave before it proved damaged is followed by a row with its error."""
    schema = _arrow(ddl)

    def one(entry: dict) -> Iterator[dict]:
        known = {"path": entry["path"], "name": entry["name"]}
        if entry["error"] is not None:
            yield known | {"error": entry["error"]}
            return
        with contextlib.closing(opened(entry["path"])) as f:
            try:
                for row in give(f, entry):
                    yield known | row
            except Damaged as e:
                yield known | {"error": str(e)}

    def run(batches):
        yield from _batched((row for b in batches for i in range(b.num_rows) for entry in b.slice(i, 1).to_pylist() for row in one(entry)), schema, weight)

    return found.mapInArrow(run, ddl)


def entries(files: DataFrame, pattern: str = "") -> DataFrame:
    """path, name, text, error of the entries of files(path, length) whose names match. The text is whole: for parts that may
    not fit in a cell take :func:`elements`."""

    def give(f, entry):
        yield {"text": b"".join(inflated(f, entry)).decode("utf-8", "replace")}

    return _read(wanted(files, pattern), give, "path string, name string, text string, error string", lambda row: len(row.get("text") or ""))


def cut_elements(pieces: Iterator[str], tag: str) -> Iterator[str]:
    """The whole elements of a tag, also those without content, of a text that comes in pieces."""
    whole = re.compile(rf"<{tag}(?:\s[^>]*)?/>|<{tag}(?:\s[^>]*)?>.*?</{tag}>", re.S)
    start = re.compile(rf"<{tag}(?=[\s/>]|\Z)")
    head = re.compile(rf"<{tag}(?:\s(?:[^>]*[^/>])?)?>")
    shut, held, waiting = f"</{tag}>", "", False
    for piece in pieces:
        new = max(0, len(held) - len(shut))
        held += piece
        if waiting and held.find(shut, new) < 0:  # the element that is open does not end yet
            continue
        at = 0
        for m in whole.finditer(held):
            yield m[0]
            at = m.end()
        begun = start.search(held, at)
        held = held[begun.start() if begun else max(at, len(held) - len(tag)) :]
        waiting = bool(begun and head.match(held))


def elements(files: DataFrame, pattern: str, tag: str, within: str | None = None) -> DataFrame:
    """path, name, no (from 1), element, error: the elements of a tag in the entries whose names match, one row each, in order.

    ``within`` names an element that they must stand in; where an entry has none, its whole text counts. An entry with an
    error may have given elements before it: who needs whole entries leaves those with an error out.
    """
    begin, shut = re.compile(rf"<{within}(?:\s[^>]*)?>"), f"</{within}>"

    def text(f, entry) -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for piece in inflated(f, entry):
            yield decoder.decode(piece)
        yield decoder.decode(b"", True)

    def inner(pieces: Iterator[str]) -> Iterator[str]:
        """What stands between the first beginning and the first end after it; nothing if there is no beginning."""
        held, inside = "", False
        for piece in pieces:
            held += piece
            if not inside:
                if m := begin.search(held):
                    held, inside = held[m.end() :], True
                else:
                    open_at = held.rfind("<")
                    held = held[open_at:] if open_at >= 0 else ""
                    continue
            if (end := held.find(shut)) >= 0:
                yield held[:end]
                return
            yield held[: max(0, len(held) - len(shut) + 1)]
            held = held[max(0, len(held) - len(shut) + 1) :]
        if inside:
            yield held

    def give(f, entry):
        limited = within is not None and next(inner(text(f, entry)), None) is not None
        for no, element in enumerate(cut_elements(inner(text(f, entry)) if limited else text(f, entry), tag), 1):
            yield {"no": no, "element": element}

    return _read(wanted(files, pattern), give, "path string, name string, no long, element string, error string", lambda row: len(row.get("element") or ""))
