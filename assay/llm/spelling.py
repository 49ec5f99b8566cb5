"""Spelling variants by Levenshtein automata over broadcast trie shards.

Words are counted over all texts; the frequent ones, sorted by range, are cut into shards of bounded
size, each a radix trie in a few flat arrays. Shards are broadcast in rounds of at most
``ROUND_BYTES``; a larger vocabulary takes more rounds and no larger broadcast. In a round each
task runs the distance-one automaton of every word of its part through every shard, depth first,
and keeps of a word's neighbours their number and the best one; rounds are reduced by word.

A run is a maximal row of letters A-Z, a-z and U+00C0 to U+00FF of a text, lower-cased A-Z alone. Where
``SLIP`` divides the unsigned crc32 h of ``<doc_id>:<run>`` (nothing before the colon if doc_id is null),
the code point h % length is left out. null and "" have no runs; repeated rows count again; runs of any
length are whole. Ties between forms go to the smaller word by code points. A form has at least
``RATIO`` times its word's count, so chains of forms end; the root is found by doubling along them. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import drop_tables, frugal, materialize, parts_for, slices, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
SLIP = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: A shard's words and code points, one word at least; bytes of shards that are broadcast together.
SHARD_WORDS, SHARD_CHARS, ROUND_BYTES = 50_000, 1 << 20, 32 << 20
#: Words for which one task looks for neighbours.
TASK_WORDS = 20_000


def slipped(word: str, start: int) -> str:
    """The run as counted; ``start`` is the crc32 of the document's id and the colon."""
    h = zlib.crc32(word.encode(), start)
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the words long and frequent enough, with their occurrences in all texts."""

    def run(batches):
        held: Counter[str] = Counter()

        def hand_on():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for piece in slices(batches, 1):
            for doc, text in zip(piece.column(0).to_pylist(), utf8(piece.column(1)), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(RUN.findall(text.lower().decode())).items():
                    if len(word) >= LEAST_LENGTH and len(word := slipped(word, start)) >= LEAST_LENGTH:
                        held[word] += n
            if len(held) >= HELD_WORDS:
                yield hand_on()
        yield hand_on()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Trie:
    """A radix trie in flat arrays. Node 0 is the root; the children of a node stand together, sorted, from
    ``first[node]`` on; ``label`` of a node is the text of the edge to it, ``heads`` the labels' first letters,
    ``count`` of a node the occurrences of the word that ends there, 0 where none does."""

    FIELDS = "first binary, ends binary, labels string, heads string, count binary"

    def __init__(self, first: np.ndarray, ends: np.ndarray, labels: str, heads: str, count: np.ndarray):
        self.first, self.heads, self.count = first.tolist(), heads, count.tolist()
        cut = [0, *ends.tolist()]
        self.label = [labels[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    @staticmethod
    def pack(words: list[str], counts: list[int]) -> dict:
        """The arrays of a trie of sorted distinct words."""
        first, label, count = [], [""], [0]
        queue = deque([(0, len(words), 0)])
        while queue:
            lo, hi, depth = queue.popleft()
            first.append(len(label))
            if lo < hi and len(words[lo]) == depth:
                count[len(first) - 1] = counts[lo]
                lo += 1
            while lo < hi:
                a = words[lo]
                end = bisect_left(words, a[:depth] + chr(ord(a[depth]) + 1), lo, hi)
                b, k = words[end - 1], depth + 1
                while k < len(a) and k < len(b) and a[k] == b[k]:
                    k += 1
                label.append(a[depth:k])
                count.append(0)
                queue.append((lo, end, k))
                lo = end
        first.append(len(label))
        ends = np.cumsum([len(x) for x in label])
        return {"first": np.array(first, np.int32).tobytes(), "ends": ends.astype(np.int32).tobytes(), "labels": "".join(label), "heads": "".join(x[:1] or " " for x in label), "count": np.array(count, np.int64).tobytes()}

    @classmethod
    def unpack(cls, first: bytes, ends: bytes, labels: str, heads: str, count: bytes) -> Trie:
        return cls(np.frombuffer(first, np.int32), np.frombuffer(ends, np.int32), labels, heads, np.frombuffer(count, np.int64))

    def rest(self, node: int, off: int, word: str, at: int) -> int:
        """Occurrences of the word whose path goes on from ``off`` in the node's edge by just ``word[at:]``; 0 if none."""
        label = self.label[node]
        if not word.startswith(label[off:], at):
            return 0
        at += len(label) - off
        while at < len(word):
            node = self.heads.find(word[at], self.first[node], self.first[node + 1])
            if node < 0 or not word.startswith(self.label[node], at):
                return 0
            at += len(self.label[node])
        return self.count[node]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words at distance one and their occurrences, each once. The walk goes down where no error was made; at the
        one place where an edge first differs from the word it tries a replaced, an inserted and a deleted letter,
        after each of which the path must go on as the word does. Other places spell the same neighbours."""
        todo, size = [(0, 0)], len(word)
        while todo:
            node, at = todo.pop()
            if at == size - 1 and self.count[node]:
                yield word[:at], self.count[node]  # the last letter deleted
            for child in range(self.first[node], self.first[node + 1]):
                label = self.label[child]
                if word.startswith(label, at):
                    todo.append((child, at + len(label)))
                    continue
                off = 0
                while at + off < size and label[off] == word[at + off]:
                    off += 1
                here, letter = at + off, label[off]
                if here < size and (n := self.rest(child, off + 1, word, here + 1)):
                    yield word[:here] + letter + word[here + 1 :], n
                if n := self.rest(child, off + 1, word, here):
                    yield word[:here] + letter + word[here:], n
                if here + 1 < size and (n := self.rest(child, off, word, here + 1)):
                    yield word[:here] + word[here + 1 :], n


def shards(words: DataFrame) -> DataFrame:
    """Packed tries of neighbouring words, each within the bounds of a shard, with their size."""
    n = words.count()

    def run(batches):
        held, counts, size = [], [], 0

        def pack():
            row = Trie.pack(held, counts)
            row["bytes"] = sum(len(v if isinstance(v, bytes) else v.encode()) for v in row.values())
            held.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("first", pa.binary()), ("ends", pa.binary()), ("labels", pa.string()), ("heads", pa.string()), ("count", pa.binary()), ("bytes", pa.int64())]))

        for b in batches:
            for word, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (len(held) >= SHARD_WORDS or size + len(word) > SHARD_CHARS):
                    yield pack()
                    size = 0
                held.append(word)
                counts.append(count)
                size += len(word)
        if held:
            yield pack()

    ranged = words.repartitionByRange(parts_for(n, SHARD_WORDS), "word").sortWithinPartitions("word")
    return ranged.mapInArrow(frugal(run), f"{Trie.FIELDS}, bytes long").withColumn("shard", F.monotonically_increasing_id())


def rounds(packed: DataFrame) -> Iterator[list[int]]:
    """Shards that are broadcast together, one at least."""
    some, size = [], 0
    for shard, each in packed.select("shard", "bytes").orderBy("shard").collect():  # a row for each SHARD_WORDS words
        if some and size + each > ROUND_BYTES:
            yield some
            some, size = [], 0
        some.append(shard)
        size += each
    if some:
        yield some


def neighbours(words: DataFrame, packed: DataFrame, some: list[int]) -> DataFrame:
    """word, near, best_n, best: over these shards, the words that have near ones, how many, and the best of them."""
    spark = words.sparkSession
    blobs = [tuple(r) for r in packed.filter(F.col("shard").isin(some)).select("first", "ends", "labels", "heads", "count").collect()]
    shared = spark.sparkContext.broadcast(blobs)

    def run(batches):
        for b in batches:
            asked = b.column(0).to_pylist()
            near, best = [0] * len(asked), [(0, "")] * len(asked)
            for blob in shared.value:
                trie = Trie.unpack(*blob)
                for i, word in enumerate(asked):
                    for other, n in trie.near(word):
                        near[i] += 1
                        top, form = best[i]
                        if n > top or n == top and other < form:
                            best[i] = n, other
            some = [i for i, n in enumerate(near) if n]
            columns = [pa.array([asked[i] for i in some], pa.string()), pa.array([near[i] for i in some], pa.int64()), pa.array([best[i][0] for i in some], pa.int64()), pa.array([best[i][1] for i in some], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "near", "best_n", "best"])

    return words.select("word").mapInArrow(frugal(run), "word string, near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of each word that has one end. Each step doubles how far is looked."""
    spark = forms.sparkSession
    hop = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = hop.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(hop.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        drop_tables(spark, hop)
        hop = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return hop


def variants(docs: DataFrame) -> DataFrame:
    """Per frequent word: word, form, root, n, n_near and form_n."""
    spark = docs.sparkSession
    words = materialize(count_words(docs), "spelling-words")
    packed = materialize(shards(words), "spelling-shards")
    asked = words.repartition(parts_for(words.count(), TASK_WORDS, spark.sparkContext.defaultParallelism), "word")
    told = [materialize(neighbours(asked, packed, some), "spelling-near") for some in rounds(packed)]
    drop_tables(spark, packed)
    if not told:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    found = told[0]
    for more in told[1:]:
        found = found.unionByName(more)
    found = found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("top"))
    placed = words.join(found, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(-F.col("top.least") >= RATIO * F.col("n"), F.struct(F.col("top.best").alias("form"), (-F.col("top.least")).alias("n"))).alias("f"))
    placed = materialize(placed, "spelling-forms").select("word", F.col("f.form").alias("form"), "n", "n_near", F.col("f.n").alias("form_n"))
    ends = roots(placed.filter("form is not null"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
