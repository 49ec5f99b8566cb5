"""LM scoring with a weighted backoff automaton.

The states are the root and every word that training saw before another token. A state's arcs are
all bigrams from it in the training texts, its failure arc leads to the root, and the root has
every word. Weights are those of a bigram model smoothed towards the root: with c the counts of
training and m = PRIOR * c(a) ** GROWTH, the arc from a to b weighs
(c(a, b) + m p(b)) / (c(a) + m) and the failure arc m / (c(a) + m), so that each state's
probabilities sum to one. m grows with a state as its number of different arcs does. A text is
scored in one pass from left to right that carries the state and sums log-probabilities.

States, arcs and the root's words grow with the corpus, so no task holds them all and none is
broadcast. Texts are packed into blocks of bounded size. Each block asks for its distinct words
and bigrams, as sorted hashes dealt into buckets by value, with its own training counts; a bucket's
task sums them and answers each block, in the order asked, with the counts of all blocks. A hot
word or bigram is asked once per block, however often it occurs.

Words are runs of non-white-space after lower-casing A-Z; each text ends in one end token, which is
also the state that a text starts from. Words and bigrams are told apart by 64-bit hashes. Null is
an empty text: the end alone. Rows without doc_id count as held out. Repeated rows are learned from
and scored each for itself; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import frugal, materialize, parts_for, slices, text_bytes, utf8

END = b"\n"  # no word has white space
FOLDS, TEST_FOLD = 10, 0
PRIOR, GROWTH = 3.0, 0.8
#: Bytes of text in a block, and of all texts for each bucket of bigrams or of words.
BLOCK_BYTES, PAIR_BYTES, WORD_BYTES = 16 << 20, 8 << 20, 64 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def marked(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(TEST_FOLD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == TEST_FOLD).alias("held_out"), "text")


def pack_blocks(docs: DataFrame) -> DataFrame:
    """block, data: the rows of a task in blocks of about BLOCK_BYTES, compressed. Narrow."""

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for part in slices(batches, 2):
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield block(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return docs.mapInArrow(frugal(run), "block long, data binary")


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as their first bytes, their second bytes and so on: equal bytes stand together for the shuffle's compression."""
    return np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ b
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


class Asked:
    """Distinct things of a block by their hash, with the block's training counts, cut into buckets."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, first: int, buckets: int):
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[self.order], counts[self.order].astype(np.uint64)
        bucket = ((self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.names, starts = np.unique(bucket, return_index=True)
        self.names += first
        self.cuts = [*starts.tolist(), len(hashes)]

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, differences of the hashes, counts)."""
        for name, a, b in zip(self.names.tolist(), self.cuts, self.cuts[1:], strict=False):
            h = self.hashes[a:b]
            yield name, planes(np.diff(h, prepend=np.uint64(0))), planes(self.counts[a:b])

    def totals(self, answers: dict[int, bytes]) -> np.ndarray:
        """The counts of all blocks, in the order in which the things were given."""
        others = [numbers(answers[name]) for name in self.names.tolist()]
        out = np.empty(len(self.order), np.int64)
        out[self.order] = (self.counts + np.concatenate(others)).astype(np.int64) if others else 0
        return out


class Block:
    """The tokens of a block's texts: distinct words and bigrams, and where they stand."""

    def __init__(self, data: bytes, buckets: tuple[int, int]):
        with pa.ipc.open_stream(data) as stream:
            rows = stream.read_all()
        self.doc_id, self.held_out = rows.column(0), rows.column(1)
        ids: dict[bytes, int] = {END: 0}
        flat, self.sizes = array("i", [0]), np.zeros(rows.num_rows, np.int64)
        for i, text in enumerate(utf8(rows.column(2))):
            ws = words_of(text)
            flat.extend([ids.setdefault(w, len(ids)) for w in ws])
            flat.append(0)
            self.sizes[i] = len(ws) + 1
        path = np.frombuffer(flat, np.int32)
        self.state, self.to = path[:-1], path[1:]
        training = np.repeat(~np.array(self.held_out.to_pylist(), bool), self.sizes)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
        pairs, self.pair = np.unique(self.state.astype(np.int64) << 32 | self.to, return_inverse=True)
        self.a, self.b = pairs >> 32, pairs & 0xFFFFFFFF
        self.words = Asked(hashes, np.bincount(self.to[training], minlength=len(ids)), buckets[0], buckets[1])
        self.pairs = Asked(mix(hashes[self.a], hashes[self.b]), np.bincount(self.pair[training], minlength=len(pairs)), 0, buckets[0])


class Automaton:
    """The states, arcs and failure arcs that a block's texts can meet."""

    def __init__(self, words: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: np.ndarray, tokens: int, distinct: int):
        """Counts of training: of each word, and of each bigram from word a to word b."""
        p = (words + 0.1) / (tokens + 0.1 * (distinct + 1))
        self.root = np.log10(p)
        prior = np.where(words > 0, PRIOR * np.maximum(words, 1) ** GROWTH, 1.0)
        self.fail = np.log10(prior / (words + prior))
        self.arc = pairs > 0
        self.weights = np.log10((pairs + prior[a] * p[b]) / (words[a] + prior[a]))

    def walk(self, state: np.ndarray, to: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The log10 probability of each step: by its arc, or by the failure arc and the root."""
        return np.where(self.arc[pair], self.weights[pair], self.fail[state] + self.root[to])


def ask(blocks: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(data, buckets)
                for asked in (block.words, block.pairs):
                    for name, hashes, counts in asked.rows():
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([name], pa.int32()), "block": pa.array([number], pa.int64()), "hashes": pa.array([hashes], pa.binary()), "counts": pa.array([counts], pa.binary())})

    return blocks.select("block", "data").mapInArrow(frugal(run), "bucket int, block long, hashes binary, counts binary")


def answer(asked: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """For each asked row the counts of the other blocks; one row of each bucket of words tells its tokens and words."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, block, hashes, counts = (rows.column(c).to_pylist() for c in ("bucket", "block", "hashes", "counts"))
        hashes, own = [np.cumsum(numbers(h), dtype=np.uint64) for h in hashes], [numbers(c) for c in counts]
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        _, of = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate(own)
        total = np.zeros(int(of.max()) + 1, np.uint64)
        np.add.at(total, of, own)
        told = [0] * len(block)
        tokens, distinct = list(told), list(told)
        if bucket[0] >= buckets[0]:
            tokens[0], distinct[0] = int(total.sum()), int((total > 0).sum())
        others = [planes(x) for x in np.split(total[of] - own, cuts)]
        return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "others": pa.array(others, pa.binary()), "tokens": pa.array(tokens, pa.int64()), "words": pa.array(distinct, pa.int64())})

    dealt = asked.repartition(sum(buckets), "bucket")
    return dealt.groupBy("bucket").applyInArrow(run, "block long, bucket int, others binary, tokens long, words long")


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """One row per document, learned from the training folds and scored by its block's part of the automaton."""
    docs = marked(docs)
    _, size = text_bytes(docs)
    buckets = parts_for(size, PAIR_BYTES, 8), parts_for(size, WORD_BYTES, 4)
    blocks = materialize(pack_blocks(docs), "lm-blocks")
    answers = materialize(answer(ask(blocks, buckets), buckets), "lm-answers")
    tokens, distinct = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("words")).first())

    def run(key, packed: pa.Table, own: pa.Table) -> pa.Table:
        block = Block(packed.column("data")[0].as_py(), buckets)
        answers = dict(zip(own.column("bucket").to_pylist(), own.column("others").to_pylist(), strict=True))
        words = block.words.totals(answers)
        automaton = Automaton(words, block.a, block.b, block.pairs.totals(answers), tokens, distinct)
        starts = np.cumsum(block.sizes) - block.sizes
        sums = [np.add.reduceat(x, starts) for x in ((words > 0)[block.to].astype(np.int64), automaton.root[block.to], automaton.walk(block.state, block.to, block.pair))]
        return pa.table({"doc_id": block.doc_id, "held_out": block.held_out, "n_tokens": pa.array(block.sizes), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(len(starts), tokens, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    dealt = blocks.repartition(parts_for(size, BLOCK_BYTES, 8), "block")
    return dealt.groupBy("block").cogroup(answers.select("block", "bucket", "others").groupBy("block")).applyInArrow(run, SCHEMA)
