"""Delimited text by a strict dialect (S4, S5, D3-D5, W1): records with their numbers, header, malformed files.

A quote opens only at the start of a field; inside it a doubled quote is one quote and line ends are
data; what follows a closing quote is added to the field. Records end at LF, CRLF or CR. A record of
one empty cell is dropped but keeps its number. A quote that never closes makes the file malformed.

``load_blocks`` reads files of any size: each in blocks by many tasks, whose quotes are told apart by running every
block from all states. ``load`` takes small files as rows that hold their content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.config import UsageError, checkpointed
from assay.findings import findings, together
from assay.functions.encoding import MOJIBAKE, decoded, mojibake
from assay.functions.text import strip_bom, trimmed
from assay.sources import blocks

MOJI = re.compile(MOJIBAKE)
RECORDS = "struct<records: array<struct<no: bigint, cells: array<string>>>, error: string>"


@dataclass(frozen=True)
class Dialect:
    """The delimiter, one character or the word tab or semicolon, and whether the first record names the columns."""

    delimiter: str = ","
    header: bool = True

    def __post_init__(self):
        mark = {"tab": "\t", "semicolon": ";"}.get(self.delimiter, self.delimiter)
        if len(mark) != 1 or mark in '"\r\n':
            raise UsageError("the delimiter must be one character, and no quote or line end")
        object.__setattr__(self, "delimiter", mark)


def split_records(text: str, delimiter: str) -> tuple[list[tuple[int, list[str]]], str | None]:
    """Numbered records of one text, or what is wrong with it."""
    mark = re.escape(delimiter)
    field = re.compile(rf'(?:"(?P<quoted>(?:[^"]|"")*+)(?P<shut>")?)?(?P<rest>[^{mark}\r\n]*)(?P<end>{mark}|\r\n|\r|\n|\Z)')
    records, cells, at, no = [], [], 0, 1
    while at < len(text) or cells:
        m = field.match(text, at)
        if m["quoted"] is not None and m["shut"] is None:
            return [], f"unterminated quoted field starting at row {no}"
        cells.append((m["quoted"] or "").replace('""', '"') + m["rest"])
        at = m.end()
        if m["end"] != delimiter:
            if cells != [""]:
                records.append((no, cells))
            cells, no = [], no + 1
    return records, None


def records(text: Column, dialect: Dialect = Dialect()) -> Column:
    """Struct of the numbered records of a text and its error."""
    delimiter = dialect.delimiter

    @F.arrow_udf(RECORDS)
    def split(texts: pa.Array) -> pa.Array:
        rows = [split_records(t or "", delimiter) for t in texts.to_pylist()]
        kind = pa.struct([("records", pa.list_(pa.struct([("no", pa.int64()), ("cells", pa.list_(pa.string()))]))), ("error", pa.string())])
        return pa.array([{"records": [{"no": no, "cells": cells} for no, cells in found], "error": error} for found, error in rows], kind)

    return split(text)


def load(files: DataFrame, dialect: Dialect = Dialect(), encoding: str = "auto") -> DataFrame:
    """One row per file of files(path, content): encoding, bom, header, width, data records, error.

    The header's first cell loses a byte order mark, all are trimmed; width is that of the widest record.
    """
    text = files.select("path", decoded(F.col("content"), encoding).alias("d"))
    parsed = text.select("path", "d.encoding", "d.bom", mojibake(F.col("d.text")).alias("garbled"), records(F.col("d.text"), dialect).alias("r"))
    named = F.transform(F.get("r.records", F.lit(0))["cells"], lambda c, i: trimmed(F.when(i == 0, strip_bom(c)).otherwise(c)))
    header = named if dialect.header else F.lit(None).cast("array<string>")
    data = F.slice("r.records", 2, F.greatest(F.size("r.records") - 1, F.lit(0))) if dialect.header else F.col("r.records")
    error = F.coalesce(F.col("r.error"), F.when(F.col("garbled"), "mojibake"), F.when(F.size("r.records") == 0, "no records"))
    return parsed.select("path", "encoding", "bom", header.alias("header"), F.array_max(F.transform("r.records", lambda x: F.size(x["cells"]))).alias("width"), data.alias("records"), error.alias("error"))


class Records:
    """The dialect as a machine over bytes (see ``blocks``): 0 a field begins, 1 in a plain field or behind a closing quote, 2 in
    quotes, 3 a quote in quotes, 4 a CR that ends a record. The bytes of quotes, line ends and delimiters stand for nothing
    else in UTF-8 and cp949, but for letters, which can be second bytes in cp949."""

    states = 5
    INSIDE = re.compile(rb'(?:[^"]++|"")*+')

    def __init__(self, delimiter: str):
        if not delimiter.isascii() or delimiter.isalpha():
            raise UsageError("files in blocks need an ASCII delimiter that is no letter")
        self.mark = delimiter.encode()
        mark = re.escape(self.mark)
        plain = rb"[^%s\r\n]*+" % mark
        field = rb'(?:"(?:[^"]++|"")*+"%s|(?!")%s)' % (plain, plain)
        self.plain = re.compile(plain)
        self.record = re.compile(rb"%s(?:%s%s)*+(?:\r\n|\n|\r(?=[\s\S]))" % (field, mark, field))

    def fields(self, data: bytes, at: int) -> int:
        """The exit state of data without a further end of a record, from a field's beginning."""
        while at < len(data):
            if data[at] == 0x22:
                at = self.INSIDE.match(data, at + 1).end() + 1
                if at >= len(data):
                    return 2 if at > len(data) else 3
            at = self.plain.match(data, at).end()
            if at == len(data):
                return 1
            if data[at : at + 1] != self.mark:
                return 4
            at += 1
        return 0

    def more(self, data: bytes, at: int):
        n = 0
        while m := self.record.match(data, at):
            n, at = n + 1, m.end()
        return n, self.fields(data, at)

    def first(self, data: bytes, state: int):
        if not data:
            return None, state
        if state == 4:
            return (1 if data[:1] == b"\n" else 0), None
        at = 0
        if state == 3 and data[:1] == b'"':
            state, at = 2, 1
        if state == 2:
            at = self.INSIDE.match(data, at).end() + 1
            if at >= len(data):
                return None, (2 if at > len(data) else 3)
        if state:
            at = self.plain.match(data, at).end()
            if at == len(data):
                return None, 1
            if data[at : at + 1] != self.mark:
                if data[at:] == b"\r":
                    return None, 4
                return at + (2 if data[at : at + 2] == b"\r\n" else 1), None
            at += 1
        m = self.record.match(data, at)
        return (m.end(), None) if m else (None, self.fields(data, at))


def load_blocks(listed: DataFrame, dialect: Dialect = Dialect(), encoding: str = "auto", block_bytes: int = blocks.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The files of listed(path, length), and their records (S4, S5, W1), each file read by many tasks.

    One row per file: path, encoding, bom, header, width, n_records (the header too), error. And path, no, cells of the data
    records of files without an error. Files are read once to find records and once more for each result.
    """
    found = blocks.scan(listed, Records(dialect.delimiter), block_bytes)
    unclosed = F.when(F.col("state") == 2, F.concat(F.lit("unterminated quoted field starting at row "), (F.col("ended") + 1).cast("string")))
    ends = blocks.with_encoding(found.files, encoding).withColumn("unclosed", unclosed)
    splits = found.splits.join(ends.filter("unclosed is null").select("path", "encoding"), "path")
    delimiter, header = dialect.delimiter, dialect.header

    def numbered(split, data):
        for no, cells in split_records(data.decode(blocks.CODECS[split["encoding"]], "replace"), delimiter)[0]:
            yield split["no"] + no - 1, cells

    def survey(split, data):
        """What the records of a split add to the row of their file."""
        top, n, width, garbled = None, 0, 0, False
        for no, cells in numbered(split, data):
            top, n, width = top or (no, cells), n + 1, max(width, len(cells))
            garbled = garbled or any(not c.isascii() and MOJI.search(c) for c in cells)
        if top:
            yield split["path"], *top, n, width, garbled

    def parse(split, data):
        for no, cells in numbered(split, data):
            if not header or no > split["first"]:
                yield split["path"], no, cells

    # What is known of a file meets its splits, which are few. Records met by their path would all go to one task.
    seen = blocks.read_splits(splits, survey, "path string, first long, top array<string>, n long, width int, garbled boolean")
    seen = seen.groupBy("path").agg(F.max("width").alias("width"), F.bool_or("garbled").alias("garbled"), F.min_by("top", "first").alias("top"), F.min("first").alias("first"), F.sum("n").alias("n"))
    named = F.transform("top", lambda c, i: trimmed(F.when(i == 0, strip_bom(c)).otherwise(c))) if header else F.lit(None).cast("array<string>")
    error = F.coalesce("unclosed", F.when(F.col("garbled"), "mojibake"), F.when(F.col("n").isNull(), "no records"))
    told = ends.join(seen, "path", "left").select("path", "encoding", "bom", named.alias("header"), "width", F.coalesce("n", F.lit(0)).alias("n_records"), error.alias("error"), "first")
    told = checkpointed(told)
    data = blocks.read_splits(splits.join(told.filter("error is null").select("path", "first"), "path"), parse, "path string, no long, cells array<string>")
    return told.drop("first"), data


def rows(loaded: DataFrame) -> DataFrame:
    """Data records of the files that could be read: path, no, cells (D3)."""
    return loaded.filter("error is null").select("path", F.explode("records").alias("r")).select("path", "r.no", "r.cells")


def cell(index: int) -> Column:
    """The cell at a 0-based place; a short record's missing cell is empty."""
    return F.coalesce(F.get("cells", F.lit(index)), F.lit(""))


def load_findings(loaded: DataFrame) -> DataFrame:
    """Files that are malformed, garbled or empty, and required headers that stand twice."""
    bad = findings(loaded.filter("error is not null"), "delimited", F.col("path"), F.col("error"), F.col("path"), F.col("error"))
    names = loaded.select("path", F.explode("header").alias("name")).groupBy("path", "name").count().filter("count > 1")
    return together(bad, findings(names, "delimited", F.col("path"), "ambiguous-column", F.col("name"), F.lit("column name stands twice"), "medium"))
