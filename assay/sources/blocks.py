"""Files in byte blocks (S1, S4, S6, W1, W2): where the records of a file begin is found by many tasks, none of which sees it whole.

Each block of a file is run from every state that it may be entered in. The outcomes are functions of the entry
state; they are composed in order, in two levels of at most ``FAN`` functions each, which tells the state and the
number of records at every block. So the file falls into splits that begin and end with a record, each with the
number of its first record, and every split is read and parsed for itself. No byte goes through a shuffle.

A machine tells where records end:
  ``states``            how many states there are; 0 is the start of a record
  ``first(data, s)``    entered in s: where the record after the first end begins, or None, and the exit state if None
  ``more(data, at)``    from a record's beginning: how many records end after it, and the exit state
"""

from __future__ import annotations

import codecs
import contextlib
import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.config import UnusableInput, UsageError, checkpointed, dealt, whole

BLOCK_BYTES = 8 << 20
FAN = 4096
BOM = b"\xef\xbb\xbf"


def opened(path: str):
    """A file of a folder that this machine sees, or of a store that Arrow knows."""
    if plain := re.fullmatch(r"(?:file:/*)?(/.*)", path if path.startswith("/") else re.sub("^file:/*", "file:/", path), re.S):
        return open(plain[1], "rb")
    from urllib.parse import quote

    import pyarrow.fs

    try:
        store, name = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
        return store.open_input_file(name)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise UnusableInput(f"no byte ranges of {path}: {e}") from None


def read_range(path: str, start: int, stop: int) -> bytes:
    with contextlib.closing(opened(path)) as f:
        f.seek(start)
        return f.read(stop - start)


# UTF-8 in pieces: (head, solid, valid, tail), head the continuation bytes that a piece starts with, tail the
# sequence that its end cuts; a piece that is all head is not solid.
def utf8_piece(data: bytes) -> tuple[bytes, bool, bool, bytes]:
    at = 0
    while at < len(data) and at < 4 and data[at] & 0xC0 == 0x80:
        at += 1
    if at == len(data) and at < 4:
        return data, False, True, b""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(data[at:])
    except UnicodeDecodeError:
        return data[:at], True, False, b""
    return data[:at], True, at < 4, decoder.getstate()[0]


def utf8_join(a, b):
    """The piece that two neighbouring pieces make."""
    if not a[1]:
        head = a[0] + b[0]
        return (head, b[1], b[2], b[3]) if len(head) < 4 else (b"", True, False, b"")
    _, solid, valid, tail = utf8_piece(a[3] + b[0]) if a[3] else (b"", True, not b[0], b"")
    if not b[1]:
        return (a[0], True, a[2], a[3]) if not b[0] else (a[0], True, a[2] and solid and valid, tail)
    between = not (a[3] or b[0]) or solid and valid and not tail
    return a[0], True, a[2] and b[2] and between, b[3]


def utf8_whole(piece) -> bool:
    return not piece[0] and piece[2] and not piece[3]


class Scan(NamedTuple):
    """``splits``: path, start, stop, no. ``files``: path, length, bom, valid (UTF-8 throughout), state (at the end), ended (records)."""

    splits: DataFrame
    files: DataFrame


def outcomes(machine, data: bytes, start: int) -> tuple[list[int], list[int], list[int]]:
    """Exit state, records ended and where the first record that begins here begins (-1 if none), for each entry state."""
    exits, counts, firsts, known = [], [], [], {}
    for state in range(machine.states):
        at, left = machine.first(data, state)
        if at is None:
            exits.append(left), counts.append(0), firsts.append(-1)
            continue
        if at not in known:
            known[at] = machine.more(data, at)
        n, left = known[at]
        exits.append(left), counts.append(n + 1), firsts.append(start + at)
    return exits, counts, firsts


PIECE = "head binary, solid boolean, good boolean, tail binary"
SUMMARY = f"path string, length long, block long, exits array<int>, counts array<long>, firsts array<long>, {PIECE}, bom boolean"
CHUNK = f"path string, length long, chunk long, exits array<int>, counts array<long>, firsts array<long>, {PIECE}, bom boolean"


def summaries(files: DataFrame, machine, block_bytes: int) -> DataFrame:
    """One row per block: what it does from each entry state, and its UTF-8 edges."""

    def run(batches):
        for b in batches:
            rows = []
            for path, length, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start = block * block_bytes
                data = read_range(path, start, min(length, start + block_bytes))
                bom = block == 0 and (data if len(data) >= 3 or length < 3 else read_range(path, 0, 3)).startswith(BOM)
                if start < 3 and (bom or block and read_range(path, 0, 3) == BOM):
                    skip = max(0, 3 - start)
                    data, start = data[skip:], start + min(skip, len(data))
                exits, counts, firsts = outcomes(machine, data, start)
                head, solid, good, tail = utf8_piece(data)
                rows.append({"path": path, "length": length, "block": block, "exits": exits, "counts": counts, "firsts": firsts, "head": head, "solid": solid, "good": good, "tail": tail, "bom": bom})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("head", pa.binary()), ("solid", pa.bool_()), ("good", pa.bool_()), ("tail", pa.binary()), ("bom", pa.bool_())])
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)).cast("long")
    blocks = files.select("path", F.col("length").cast("long").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return dealt(blocks, "path", "block").mapInArrow(run, SUMMARY)


def compose(rows: pd.DataFrame, states: int) -> tuple[list[int], list[int], list[int], tuple]:
    """The function of neighbouring blocks, in order, one after the other."""
    exits, counts, firsts, piece = list(range(states)), [0] * states, [-1] * states, (b"", False, True, b"")
    for row in rows.itertuples():
        for s in range(states):
            at = exits[s]
            if firsts[s] < 0:
                firsts[s] = int(row.firsts[at])
            counts[s] += int(row.counts[at])
            exits[s] = int(row.exits[at])
        piece = utf8_join(piece, (row.head, row.solid, row.good, row.tail))
    return exits, counts, firsts, piece


def scan(files: DataFrame, machine, block_bytes: int = BLOCK_BYTES) -> Scan:
    """Record-aligned splits of files(path, length), and what is known of each file. An empty file has no split.

    The first of a split's records has number ``no``. What stands after the last end is a record too unless it is
    nothing. Blocks are summed up once, in a table that is cut from its lineage; the splits come of it alone.
    """
    whole("block_bytes", block_bytes, 1)
    states = machine.states
    blocks = checkpointed(summaries(files, machine, block_bytes))
    numbered = blocks.withColumn("chunk", (F.col("block") / FAN).cast("long"))

    def chunk_function(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        exits, counts, firsts, piece = compose(rows, states)
        return pd.DataFrame([(key[0], int(rows.length.iloc[0]), key[1], exits, counts, firsts, *piece, bool(rows.bom.any()))], columns=[c.split()[0] for c in CHUNK.split(", ")])

    chunks = numbered.groupBy("path", "chunk").applyInPandas(chunk_function, CHUNK)

    def entries(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Per chunk of a file: state and records ended at its entry, where the split after it begins; the file's end in its last row."""
        rows = rows.sort_values("chunk")
        state, ended, out, piece = 0, 0, [], (b"", False, True, b"")
        for row in rows.itertuples():
            out.append([key[0], row.length, row.chunk, state, ended, int(row.firsts[state])])
            ended += int(row.counts[state])
            state = int(row.exits[state])
            piece = utf8_join(piece, (row.head, row.solid, row.good, row.tail))
        follows = [int(rows.length.iloc[0])] * len(out)
        for i in range(len(out) - 2, -1, -1):
            follows[i] = out[i + 1][5] if out[i + 1][5] >= 0 else follows[i + 1]
        n = len(out)
        return pd.DataFrame(
            [(*o[:5], follows[i], i == n - 1, bool(rows.bom.iloc[0]), utf8_whole(piece), state, ended) for i, o in enumerate(out)],
            columns=["path", "length", "chunk", "state", "ended", "follows", "last", "bom", "valid", "end_state", "end_ended"],
        )

    entered = checkpointed(chunks.groupBy("path").applyInPandas(entries, "path string, length long, chunk long, state int, ended long, follows long, last boolean, bom boolean, valid boolean, end_state int, end_ended long"))

    def chunk_splits(key, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        """Splits that begin in a chunk, from its entry on; the file's first begins at its first byte."""
        e = entry.iloc[0]
        state, ended, out = int(e.state), int(e.ended), []
        if key[1] == 0:
            out.append([min(len(BOM), int(e.length)) if e.bom else 0, 1])
        for row in rows.sort_values("block").itertuples():
            if row.counts[state]:
                out.append([int(row.firsts[state]), ended + 2])
            ended += int(row.counts[state])
            state = int(row.exits[state])
        stops = [o[0] for o in out[1:]] + [int(e.follows)]
        return pd.DataFrame([(key[0], a, b, no) for (a, no), b in zip(out, stops, strict=True) if a < b] if out else [], columns=["path", "start", "stop", "no"])

    splits = numbered.groupBy("path", "chunk").cogroup(entered.groupBy("path", "chunk")).applyInPandas(chunk_splits, "path string, start long, stop long, no long")
    ends = entered.filter("last").select("path", "length", "bom", "valid", F.col("end_state").alias("state"), F.col("end_ended").alias("ended"))
    return Scan(splits, ends)


def read_splits(splits: DataFrame, parse, schema: str, rows_at_once: int = 5000) -> DataFrame:
    """Rows of ``parse(row, bytes)`` for each split of a table that has path, start and stop; other columns reach ``parse``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = [f.name for f in arrow]

    def run(batches):
        held = []
        for b in batches:
            for split in b.to_pylist():
                for row in parse(split, read_range(split["path"], split["start"], split["stop"])):
                    held.append(dict(zip(names, row, strict=True)))
                    if len(held) >= rows_at_once:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
        yield pa.RecordBatch.from_pylist(held, arrow)

    return dealt(splits, "path", "start").mapInArrow(run, schema)


class Lines:
    """Lines end at LF, CRLF or CR. State 1: a CR was last, so that the line is over and a LF still belongs to its end."""

    states = 2
    END = re.compile(rb"\r\n|\r|\n")

    def first(self, data: bytes, state: int):
        if state == 1:
            return (1 if data[:1] == b"\n" else 0, None) if data else (None, 1)
        m = self.END.search(data)
        if m is None:
            return None, 0
        return (None, 1) if m[0] == b"\r" and m.end() == len(data) else (m.end(), None)

    def more(self, data: bytes, at: int):
        n = data.count(b"\n", at) + data.count(b"\r", at) - data.count(b"\r\n", at)
        waiting = at < len(data) and data.endswith(b"\r")
        return n - waiting, int(waiting)


CODECS = {"utf8": "utf-8", "cp949": "cp949"}


def with_encoding(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """A scan's files with the ``encoding`` that they are read in: as told, else UTF-8 if marked or valid throughout, else cp949."""
    if encoding not in ("auto", *CODECS):
        raise UsageError(f"encoding is auto, utf8 or cp949, not {encoding!r}")
    own = F.when(F.col("bom") | F.col("valid"), "utf8").otherwise("cp949")
    return files.withColumn("encoding", own if encoding == "auto" else F.lit(encoding))


BLANK = re.compile(r"[\s\ufeff]*")


def lines(files: DataFrame, encoding: str = "auto", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, number, text of the lines that are not blank; numbers count blank lines."""
    found = scan(files, Lines(), block_bytes)
    splits = found.splits.join(with_encoding(found.files, encoding).select("path", "encoding"), "path")

    def parse(split, data):
        text = data.decode(CODECS[split["encoding"]], "replace")
        for i, line in enumerate(re.split(r"\r\n|\r|\n", text)):
            if not BLANK.fullmatch(line):
                yield split["path"], split["no"] + i, line

    return read_splits(splits, parse, "path string, number long, text string")


def lines_in(split: dict, data: bytes, codec: str) -> list[bytes]:
    """The lines of a part of a file that are not blank; one that begins before the part is left out."""
    some = Lines.END.split(data)
    return [x for x in (some if split["start"] == 0 else some[1:]) if not BLANK.fullmatch(x.decode(codec, "replace"))]


def last_ranges(files: DataFrame, n: int, encoding: str = "utf8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, start, stop: the end of each file that holds its last ``n`` lines that are not blank.

    1, 2, 4, ... blocks are read from the end until there are so many. A round reads all the files that still lack some.
    """
    whole("n", n, 1)
    if encoding not in CODECS:
        raise UsageError(f"encoding is utf8 or cp949, not {encoding!r}")
    codec = CODECS[encoding]

    def count(split, data):
        yield split["path"], split["start"], split["stop"], len(lines_in(split, data, codec))

    todo, done, blocks = files.select("path", F.col("length").cast("long").alias("stop")), None, 1
    while True:
        start = F.greatest(F.lit(0).cast("long"), F.col("stop") - blocks * block_bytes)
        seen = checkpointed(read_splits(todo.select("path", start.alias("start"), "stop"), count, "path string, start long, stop long, n long"))
        enough = (F.col("n") >= n) | (F.col("start") == 0)
        done = seen.filter(enough) if done is None else done.unionByName(seen.filter(enough))
        todo = seen.filter(~enough).select("path", "stop")
        if todo.isEmpty():
            return done.select("path", "start", "stop")
        blocks *= 2


def last_lines(files: DataFrame, n: int, encoding: str = "utf8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, from_end (1 is the last), text of the last ``n`` lines that are not blank of each file (P32, W4). The rest of
    the file is not read, so its ``encoding`` must be told."""
    ranges, codec = last_ranges(files, n, encoding, block_bytes), CODECS[encoding]

    def tail(split, data):
        for i, line in enumerate(reversed(lines_in(split, data, codec)[-n:]), 1):
            yield split["path"], i, line.decode(codec, "replace")

    return read_splits(ranges, tail, "path string, from_end long, text string")
