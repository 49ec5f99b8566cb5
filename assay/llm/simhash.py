"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most
``DISTANCE`` bits agree on at least ``BLOCKS - DISTANCE`` blocks, so each choice of so many blocks is
a join key, and every close pair shares one of them. Equal fingerprints are one row before the
join, so exact copies cost nothing there. Pairs that meet on a key are verified by Hamming distance.

A key with more than ``CROWDED`` fingerprints (a large group of near copies) is not expanded into its
pairs. Its members meet by midpoint instead: two fingerprints that agree on the key's blocks and differ
in at most two bits both lie within one bit of some third value, so each offers itself and its one-bit
neighbours outside these blocks, and all that offer a value are tied to the smallest of them. That is
exact as well, and linear: a member offers 65 values at most and a value is offered by 65 at most.

Words are runs between ASCII white space, lower-cased A-Z; a document with fewer than three is one
shingle; null, "" and white space have none, their fingerprint is zero and links like any other.
Texts are read whole, in steps of bounded memory. Repeated rows are documents of their own. A
component's id is the smallest doc_id in it; null ids count for nothing there, and a component of
them alone has none. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import drop_tables, frugal, materialize, slices, utf8
from assay.llm.ngram_join import components

SHINGLE, SEED, BITS = 3, 42, 64
#: Links differ in so many bits at most; midpoints need two.
DISTANCE = 2
#: More blocks give longer keys, of which there are more: 10 keys of about 38 bits here.
BLOCKS = 5
#: Fingerprints of one key that are joined as pairs; above, they meet by midpoint. Changes cost, not results.
CROWDED = 64
STEP_SHINGLES = 1 << 16


def fingerprint(text: bytes) -> int:
    """Bits that are set in over half of the shingles' hashes, repeats included."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        words = [b" ".join(words)] if words else []
        shingles = iter(words)
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(SHINGLE)), strict=False))
    total, counts = 0, np.zeros(BITS, np.int64)
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    while len(step := np.fromiter(itertools.islice(hashes, STEP_SHINGLES), ">u8")):
        counts += np.unpackbits(step.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(step)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the fingerprint's 64 bits as a signed number, of every row."""

    def run(batches):
        for piece in slices(batches, 1):
            prints = [fingerprint(t) for t in utf8(piece.column(1))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, print long")


def signed(bits: int) -> int:
    return bits - (bits >> 63 << 64)


def key_masks(blocks: int = BLOCKS) -> list[int]:
    """The bits of each choice of blocks on which a close pair may agree."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(cuts)]
    return [signed(functools.reduce(operator.or_, some)) for some in itertools.combinations(block, blocks - DISTANCE)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def midpoint_links(crowded: DataFrame) -> DataFrame:
    """a, b: fingerprints (print, free: bits that may be flipped) tied to the smallest that shares a midpoint."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS)))
    offers = crowded.select("print", F.explode(F.transform(F.filter(flips, lambda x: x.bitwiseAND(F.col("free")) == x), lambda x: x.bitwiseXOR(F.col("print")))).alias("middle"))
    least = offers.groupBy("middle").agg(F.min("print").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("middle", "a")
    return offers.join(least, "middle").select("a", F.col("print").alias("b")).filter("a != b").distinct()


def links(prints: DataFrame) -> DataFrame:
    """a, b: enough verified pairs of the distinct ``print`` that every two close ones are connected through close ones."""
    spark = prints.sparkSession
    masks = key_masks()
    keyed = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col("print").bitwiseAND(F.lit(m)).alias("key"), F.lit(~m).alias("free")) for i, m in enumerate(masks)))).alias("k")
    keys = materialize(prints.select("print", keyed).select("print", "k.*"), "simhash-keys")
    sizes = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keys.join(sizes, ["kind", "key"]), "simhash-shared")
    few, many = shared.filter(F.col("n") <= CROWDED), shared.filter(F.col("n") > CROWDED)
    other = few.select("kind", "key", F.col("print").alias("b"))
    close = (F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= DISTANCE)
    pairs = few.select("kind", "key", F.col("print").alias("a")).join(other, ["kind", "key"]).filter(close).select("a", "b").distinct()
    tied = midpoint_links(many.groupBy("print").agg(F.bit_or("free").alias("free"))).filter(distance(F.col("a"), F.col("b")) <= DISTANCE)
    found = materialize(pairs.unionByName(tied), "simhash-links")
    drop_tables(spark, keys, shared)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits) and component_id."""
    prints = materialize(fingerprints(docs), "simhash-prints")
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    node = components(links(distinct.select("print"))).withColumnRenamed("node", "print")
    placed = distinct.join(node, "print", "left").select("print", "least", F.coalesce("component", "print").alias("class"))
    least = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    told = placed.join(least, "class").select("print", "component_id")
    return prints.join(told, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
