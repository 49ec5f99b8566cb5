"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step looks at together; a longer text makes a step of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``. Where that is unset a single machine takes a
    temporary folder; a cluster has none that all of it shares, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = f"file://{tempfile.gettempdir()}/assay-checkpoints"
    return f"{root.rstrip('/')}/assay/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once nothing reads them any more."""
    for df in frames:
        for top in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/assay/" in top:
                path = spark._jvm.org.apache.hadoop.fs.Path(top)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system. Workers outlive tasks and operators, and the allocators keep what they free."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """``run`` for mapInArrow, with the worker's freed memory given back before it starts and after it ends."""

    @functools.wraps(run)
    def outer(batches):
        give_back()
        yield from run(batches)
        give_back()

    return outer


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of the text column, one row at least."""
    for batch in batches:
        sizes = (s or 0 for s in pc.binary_length(batch.column(text)).to_pylist())
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, counted over all rows."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return int(row[0]), int(row[1] or 0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def parts_for(size: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(size / each))


def chunked(items: Iterator, n: int) -> Iterator[list]:
    items = iter(items)
    while chunk := list(itertools.islice(items, n)):
        yield chunk


FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame):
    """A test for a column of ids: false only for ids that are not in ``ids``. A bitmap of fixed size
    is broadcast; the more ids there are, the more others pass, and the join after it settles those."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("long")
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def test(bits: pa.Array) -> pa.Array:
        x = bits.to_numpy()
        return pa.array((shared.value[x >> 6] >> (x & 63) & 1).astype(bool))

    return lambda column: test(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("long"))
