"""WARC archives: write, read back, and merge the capture index externally.

Each writing task makes one archive whose captures are in (URL key, time) order: a sorted run.
Reading an archive from front to back gives that run again. The runs are cut at common key
borders by a range exchange, and in each key range a loser tree merges its k runs, so the
partitions in order hold every URL's capture history in global order.

Records of equal payload: those with the largest page_id are responses, the others revisits of
it. Null html is an empty payload. A null page_id counts as smaller than any other, is a revisit
where an equal payload has a page_id, and else a response. Repeated rows with the largest
page_id are all responses. A null URL has the empty key. An empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import chunked, materialize, parts_for, shared_dir

READ_BYTES = 1 << 20
#: Index entries that one merging task holds, and of each run that its cursor has read ahead.
MERGE_ROWS, CURSOR_ROWS = 500_000, 500
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then path and query: pages of a site sort together."""
    url = F.coalesce(url, F.lit(""))
    start = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, start + r"(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, start + r"[^/?#]*", ""), r"#.*", "")
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str, seconds: int, payload: bytes, owner: int | None) -> bytes:
    """One gzip member with a response (owner is None) or a revisit of the owner's record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if owner is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Date: {(EPOCH + timedelta(seconds=seconds)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if owner is None:
        block += payload
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{owner}>"]
    lines.append(f"Content-Length: {len(block)}")
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, read front to back in bounded steps."""
    offset, held = 0, b""
    while True:
        inflate, out, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not held:
                held = stream.read(READ_BYTES)
                if not held:
                    if used:
                        raise ValueError(f"archive ends inside the record at {offset}")
                    return
            out.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield offset, used, b"".join(out)
        offset += used


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
    return fields, rest[:size]


def page_of(uri: str) -> int | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


ENTRY = "run int, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long"
ENTRY_ARROW = pa.schema([("run", pa.int32()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64())])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder`` and return one row per archive: run, archive, records.

    An attempt writes a file of its own and only a finished attempt's name is returned, so a lost
    executor's half-written file is never read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        url_key(F.col("url")).alias("url_key"),
        F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"),
    )
    # pages meet their payload's owner by digests alone; the payloads themselves move by page, so a common one is spread
    keys = rows.select("sha1", "page_id").distinct()
    owners = keys.groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1 and owner is not null").select("sha1", "owner")
    owned = keys.join(owners, "sha1").select(F.col("sha1").alias("same"), F.col("page_id").alias("page"), "owner")
    placed = (
        rows.join(owned, (rows.sha1 == owned.same) & rows.page_id.eqNullSafe(owned.page), "left")
        .withColumn("seconds", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)).cast("int"))
        .select("url_key", "seconds", "page_id", "url", "html", F.when(F.coalesce(F.col("page_id") < F.col("owner"), F.col("owner").isNotNull()), F.col("owner")).alias("owner"))
        .sortWithinPartitions("url_key", "seconds", F.col("page_id").asc_nulls_first())
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))
        name, out, n = f"run-{part:06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for _, seconds, page_id, url, html, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}")
                    out.write(record(page_id, url, seconds, html.encode("utf-8", "surrogatepass"), owner))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"run": pa.array([part], pa.int32()), "archive": [name], "records": pa.array([n], pa.int64())})

    return placed.mapInArrow(run, "run int, archive string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Index entries of every record, each archive read once and in order. A response's payload is
    checked against its digest; a revisit has size and digest of the full payload in its headers."""

    def run(batches):
        store, top = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))
        for batch in batches:
            for number, archive, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{top}/{archive}") as stream:
                    for offset, length, content in members(stream):
                        fields, block = parse(content)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{archive} at {offset}: payload and digest differ")
                        rows.append((number, fields["WARC-Target-URI"], fields["WARC-Date"], page_of(fields["WARC-Record-ID"]), size, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, archive, offset, length))
                        seen += 1
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENTRY_ARROW.types, strict=True)], schema=ENTRY_ARROW)
                            rows = []
                if seen != records:
                    raise ValueError(f"{archive} has {seen} records, {records} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENTRY_ARROW.types, strict=True)], schema=ENTRY_ARROW)

    # one archive per task: their number is that of the tasks that wrote them
    return archives.repartition(max(1, archives.count())).mapInArrow(run, ENTRY).withColumn("url_key", url_key(F.col("url_key")))


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so taking the
    smallest and refilling from its run replays one path of log2 k matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.tree = [-1] * self.k  # losers; tree[0] is the winner
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; an ended run comes last, and ties go to the smaller run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its match
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield winner, self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merge_index(entries: DataFrame, rows: int) -> DataFrame:
    """All runs merged: partitions in order hold the entries by (url_key, captured, page_id)."""
    parts = parts_for(rows, MERGE_ROWS, entries.sparkSession.sparkContext.defaultParallelism)
    ranged = entries.repartitionByRange(parts, "url_key", "captured", F.col("page_id").asc_nulls_first()).sortWithinPartitions("run", "url_key", "captured", F.col("page_id").asc_nulls_first())

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        data = pa.Table.from_batches(held)
        numbers = data.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])).tolist()

        def cursor(at: int, end: int) -> Iterator[tuple]:
            # a run's keys are read a few at a time, as the tree takes them
            for lo in range(at, end, CURSOR_ROWS):
                part = data.slice(lo, min(CURSOR_ROWS, end - lo))
                keys, times, pages = (part.column(c).to_pylist() for c in (1, 2, 3))
                yield from zip(keys, times, ((x is not None, x or 0) for x in pages), range(lo, lo + part.num_rows), strict=True)

        merged = (key[3] for _, key in LoserTree([cursor(a, b) for a, b in zip(starts, [*starts[1:], data.num_rows], strict=True)]))
        for some in chunked(merged, 20_000):
            yield from data.take(pa.array(some, pa.int64())).combine_chunks().to_batches()

    return ranged.mapInArrow(run, ENTRY)


def capture_index(pages: DataFrame) -> DataFrame:
    """Write, read back and merge: one entry per page, in capture order."""
    folder = shared_dir(pages.sparkSession, "warc")
    archives = materialize(write_archives(pages, folder), "warc-list")
    rows = archives.selectExpr("coalesce(sum(records), 0)").first()[0]
    return merge_index(read_archives(archives, folder), int(rows))
