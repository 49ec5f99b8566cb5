"""Benchmark decontamination as a prefix-filtered set join with exact window verification.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window's set
is its word shingles, ordered by how rare they are over all documents. A document that holds a
window holds all its shingles, so the rarest alone (a prefix of length one) is the necessary join
token. Its place in the window bounds the position in the document, the document's end bounds the
length, and each candidate is then compared word by word.

Neither the benchmark nor its index is collected or broadcast: windows, shingles and join tokens are
tables. What goes to all tasks is a bitmap of fixed size that lets most other shingles of a document
fall before the join; the join on the token settles the rest.

Null and "" have no words; an item without words has no window; items with equal ids count once,
null ids not at all in lists; repeated documents are judged each for itself; extra columns are
not read. Empty tables give no hits or an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import drop_tables, fresh, frugal, id_filter, materialize, slices, utf8

#: Bytes that are no letter or digit stand between words; A-Z become lower case.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WINDOW = 10
SHINGLE = 3
#: Bits of the broadcast bitmap of tokens; fewer let more shingles through to the join and change nothing else.
TOKEN_BITS = 1 << 25
COUNT_TOKENS = 200_000  # tokens whose counts a task holds


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class WordHashes(dict):
    """64-bit hashes of words, kept for the words that a task meets first."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


def tokens(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit token for each run of k words."""
    n = max(0, len(hashes) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, size, words: the distinct windows of each item, words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for item, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                rows += [(item, size, b" ".join(words[at : at + size])) for at in range(len(words) - size + 1 if size else 0)]
            for at in range(0, len(rows), 50_000):
                item, size, words = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(words, pa.binary())], ["item", "size", "words"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(frugal(run), "item string, size int, words binary").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """k, token, place of every shingle of the windows(size, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            row, k_of, token, place = [], [], [], []
            for i, (size, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                k = min(SHINGLE, size)
                h = tokens(np.fromiter(map(hashes.__getitem__, words.split()), np.uint64, size), k)
                row += [i] * len(h)
                k_of += [k] * len(h)
                token.append(h)
                place += range(len(h))
            if row:
                of = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(k_of, pa.int32()), pa.array(np.concatenate(token).view(np.int64)), pa.array(place, pa.int32())], ["size", "words", "k", "token", "place"])

    return windows.select("size", "words").mapInArrow(frugal(run), "size int, words binary, k int, token long, place int")


class TokenFilter:
    """A bitmap of the tokens of a table: a test that is false only for tokens that it has not."""

    def __init__(self, table: DataFrame):
        bits = TOKEN_BITS
        bit = F.expr(f"token & {bits - 1}L")
        words = table.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        bitmap = np.zeros(max(1, bits >> 6), np.int64)
        bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.sizes = sorted(r[0] for r in table.select("k").distinct().collect())  # SHINGLE at most
        self.shared, self.mask = table.sparkSession.sparkContext.broadcast(bitmap), bits - 1

    def places(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        return np.flatnonzero(self.shared.value[at >> 6] >> (at & 63) & 1)


def hashed(texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for text in texts:
        words = words_of(text)
        yield words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_counts(docs: DataFrame, wanted: TokenFilter) -> DataFrame:
    """k, token, n: how often shingles that pass the filter occur over all documents, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), {k: [] for k in wanted.sizes}, 0

        def told() -> Iterator[pa.RecordBatch]:
            for k, some in held.items():
                if some:
                    token, n = np.unique(np.concatenate(some), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), k, np.int32)), pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "token", "n"])
                    some.clear()

        for part in slices(batches, 0):
            for _, h in hashed(utf8(part.column(0)), hashes):
                for k in wanted.sizes:
                    t = tokens(h, k)
                    t = t[wanted.places(t)]
                    held[k].append(t)
                    size += len(t)
            if size > COUNT_TOKENS:
                yield from told()
                size = 0
        yield from told()

    return docs.select("text").mapInArrow(frugal(run), "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))


def join_tokens(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """k, token, place, size, words: the rarest shingle of each distinct window."""
    shingles = window_shingles(windows.select("size", "words").distinct())
    counts = shingle_counts(docs, TokenFilter(shingles))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")
    return shingles.join(counts, ["k", "token"], "left").groupBy("size", "words", "k").agg(F.min(order).alias("first")).select("k", "first.token", "first.place", "size", "words")


FOUND = "key binary, doc_id long, n_words long, k int, token long, at int, near binary, before int"


def find(docs: DataFrame, wanted: TokenFilter, window: int) -> DataFrame:
    """A row for each document (k is null), and one for each shingle of it that may be a join token: its place ``at``
    and the words around it that a window can reach, of which ``before`` stand before it. The key tells a document
    from others with its doc_id."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, 1):
            texts, out = utf8(part.column(1)), []
            for doc, text, (words, h) in zip(part.column(0).to_pylist(), texts, hashed(texts, hashes), strict=True):
                key = xxhash.xxh3_128_digest(text) + str(doc).encode()
                out.append((key, doc, len(words), None, None, None, None, None))
                for k in wanted.sizes:
                    t = tokens(h, k)
                    for at in wanted.places(t).tolist():
                        start = max(0, at - window + 1)
                        out.append((key, doc, None, k, int(t[at].view(np.int64)), at, b" ".join(words[start : at + window]), at - start))
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[at : at + 20_000], strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), FOUND)


def hits(found: DataFrame, index: DataFrame) -> DataFrame:
    """key, doc_id, start, size, words of the windows that stand in documents: joined by token, compared word by word."""
    both = found.filter("k is not null").join(index, ["k", "token"])
    first = F.col("before") - F.col("place")
    inside = F.slice(F.split(F.col("near").cast("string"), " "), F.greatest(first, F.lit(0)) + 1, F.col("size"))
    same = (first >= 0) & (F.array_join(inside, " ") == F.col("words").cast("string"))
    return both.filter(same).select("key", "doc_id", (F.col("at") - F.col("place")).alias("start"), "size", "words").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What find gives, the hits in it and the windows, as tables."""
    windows = materialize(item_windows(benchmark, window), "leak-windows")
    index = materialize(join_tokens(windows, docs), "leak-tokens")
    found = materialize(find(docs, TokenFilter(index), window), "leak-candidates")
    hit = materialize(hits(found, index), "leak-hits")
    drop_tables(docs.sparkSession, index)
    return found, hit, windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Texts are read twice and not shuffled."""
    found, hit, windows = leaks(docs, benchmark, window)
    covered = hit.select("key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).groupBy("key").agg(F.count_distinct("word").alias("n_hit"))
    named = hit.select("key", "size", "words").distinct().join(windows.filter("item is not null"), ["size", "words"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = found.filter("k is null").join(covered, "key", "left").join(named, "key", "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item, with all their columns. Only documents whose doc_id may be
    one of a contaminated document meet the list of those; no other text is shuffled."""
    _, hit, _ = leaks(docs, benchmark, window)
    bad = hit.select("key", "doc_id").distinct()
    may_be = id_filter(bad.select(F.col("doc_id").alias("id")))

    @F.arrow_udf("binary")
    def key_of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(t) + str(d).encode() for d, t in zip(ids.to_pylist(), utf8(texts), strict=True)], pa.binary())

    plain = [F.col(f"`{c}`") for c in docs.columns]
    mark, key, bad_key = fresh(docs, "__may_be", "__key", "__bad_key")
    marked = docs.withColumn(mark, may_be(F.col("doc_id").cast("long")))
    doubtful = marked.filter(F.col(mark)).select(*plain, key_of(F.col("doc_id").cast("long"), F.col("text")).alias(key))
    kept = doubtful.join(bad.select(F.col("key").alias(bad_key)), F.col(key) == F.col(bad_key), "left_anti")
    return marked.filter(~F.col(mark)).select(*plain).unionByName(kept.select(*plain))
