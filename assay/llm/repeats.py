"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

No index of the whole corpus fits one machine, so equal strings are first brought together.
Each window of ``window`` bytes has an anchor, the leftmost smallest hash of its k-byte strings;
equal windows have equal anchors. Anchors are dealt by hash:

* anchors met once hold no repeated window;
* anchors whose whole surroundings are equal are copies: all but the first are removed as they are;
* the other anchors' windows go, one group of bounded size after the other, into an index: a
  run-compressed Burrows-Wheeler transform with the suffix position and the length of the match
  with the preceding suffix sampled where runs start. Streaming over the text, the match length at
  each position follows from the last sample before it, and windows whose match is long enough
  fall into classes of which only the earliest stays.

Groups above ``HOT`` surroundings are split into single windows, dealt by the window's own hash
and reduced before the shuffle, so no group lands in one task.

Texts are UTF-8 bytes; null is empty. A window is repeated if it also starts at a smaller doc_id, or
earlier in the same document; rows with equal doc_id count as one place, so they do not remove each
other's bytes at equal offsets. Rows without doc_id come before all others, in the order of a hash of
their text (doc_ids below -2**62 are not told from those). Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import frugal, materialize, parts_for, slices, text_bytes, utf8

WINDOW = 100
GRAM = 32
HOT = 20_000
INDEX_BYTES = 1 << 20
BLOCK_BYTES = 12 << 20
PACKED = 7  # symbols of the first sort
PIECE = 1 << 20  # bytes of one text that are looked at together
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substrings of a byte row, from prefix sums modulo 2**64."""

    up = down = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.up) < n:
            Rolling.up, Rolling.down = powers(BASE, n), powers(INVERSE, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return self.mixed(h)

    def grams(self, k: int) -> np.ndarray:
        return self.mixed((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)


def sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks of w."""
    n = len(keys)
    rows = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = keys
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the texts data[starts:ends]: text, anchor, first and last window start, anchor hash and
    hash of the surroundings of each anchor. Offsets are those of ``data``."""
    none = (np.empty(0, np.int64),) * 6
    if len(data) < WINDOW:
        return none
    roll = Rolling(data)
    grams = roll.grams(GRAM)
    bits = np.uint64(23)  # data has fewer than 2**23 bytes
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(keys, WINDOW - GRAM + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), np.maximum(0, ends - starts - WINDOW + 1))
    if not len(text):
        return none
    first = np.repeat(starts, np.maximum(0, ends - starts - WINDOW + 1))
    run = np.concatenate([[0], np.cumsum(np.maximum(0, ends - starts - WINDOW + 1))])[:-1]
    window = first + np.arange(len(text)) - run[text]
    at = at[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(text)) - 1
    text, at, lo, hi = text[new], at[new], window[new], window[last]
    left, right = np.maximum(starts[text], at - (WINDOW - GRAM)), np.minimum(ends[text], at + WINDOW)
    around = Rolling.mixed(roll(left, right) + ((at - left) << 8 | right - at).astype(np.uint64))
    return text, at, lo, hi, grams[at], around


def pack(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return at << 14 | (at - lo) << 7 | (at - hi)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 14
    return at, at - (place >> 7 & 127), at - (place & 127)


def anchor_rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, anchor hash, surroundings' hash), in pieces of bounded size."""
    held, size = [], 0
    groups = []
    for i, t in enumerate(texts):
        if held and size + len(t) > PIECE:
            groups.append(held)
            held, size = [], 0
        held.append(i)
        size += len(t)
    for group in [*groups, held]:
        if len(group) == 1 and len(texts[group[0]]) > PIECE:
            # a long text in overlapping pieces; each anchor is taken from the piece that has all around it
            t, step, margin = texts[group[0]], PIECE, 2 * WINDOW
            for a in range(0, len(t), step):
                lo, hi = max(0, a - margin), min(len(t), a + step + margin)
                data = np.frombuffer(t[lo:hi], np.uint8)
                text, at, first, last, h, around = anchors(data, np.array([0]), np.array([len(data)]))
                own = (at + lo >= a) & (at + lo < a + step)
                yield np.full(int(own.sum()), group[0]), pack(at[own] + lo, first[own] + lo, last[own] + lo), h[own], around[own]
        elif group:
            lengths = np.array([len(texts[i]) for i in group], np.int64)
            ends = np.cumsum(lengths)
            text, at, first, last, h, around = anchors(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), ends - lengths, ends)
            base = (ends - lengths)[text] if len(text) else text
            yield np.array(group)[text] if len(text) else text, pack(at - base, first - base, last - base), h, around


def index_classes(segments: list[bytes]) -> np.ndarray:
    """For each position of the segments, joined with one byte between them: the earliest position
    whose match is at least WINDOW long (itself if none comes earlier)."""
    lengths = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    first, _ = earliest_windows(data, lengths)
    return first


def earliest_windows(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`index_classes`, of segments that stand one after the other; also each position's segment.

    Each segment ends in a symbol of its own, smaller than all bytes and ordered by segment, so no
    match goes over a border and all suffixes differ.
    """
    n = int(lengths.sum()) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    segment = np.repeat(np.arange(len(lengths)), lengths + 1)
    room = ends[segment] - np.arange(n)  # symbols before the border
    text = np.zeros(n + PACKED, np.int64)
    text[:n][room > 0] = data
    text[:n][room > 0] += 1
    # Suffix order by doubling from the first seven symbols on; only tied suffixes are sorted again.
    packed = np.zeros(n, np.int64)
    for j in range(PACKED):
        packed = packed * 257 + np.where(room > j, text[j : j + n], 0)
    order = np.argsort(packed)
    rank = np.empty(n, np.int64)
    live, slots, keys, width = order, np.arange(n), packed[order], PACKED
    while True:
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(new, len(keys)))
        rank[live] = np.repeat(slots[new], size)
        tied = np.repeat(size > 1, size)
        live, slots = live[tied], slots[tied]
        if not len(live):
            break
        after = np.where(room[live] < width, segment[live], rank[np.minimum(live + width, n - 1)])
        keys = rank[live] * (n + 1) + after
        by = np.argsort(keys)
        live, keys = live[by], keys[by]
        order[slots] = live
        width *= 2
    # Run-compressed transform: what precedes each suffix; samples where a run starts.
    before = text[order - 1]
    opens = np.zeros(n, bool)
    opens[np.concatenate([[0], ends[:-1] + 1])] = True
    starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]) | opens[order])
    here, above = order[starts], order[np.maximum(starts - 1, 0)]
    least = np.where(starts > 0, np.minimum(room[here], room[above]), 0)
    match = np.zeros(len(starts), np.int64)
    for step, symbols in ((PACKED, packed), (1, text)):
        live = np.flatnonzero(match < least)
        while len(live):
            at = match[live]
            live = live[symbols[here[live] + at] == symbols[above[live] + at]]
            match[live] += step
            live = live[match[live] < least[live]]
    match = np.minimum(match, least)
    # Match lengths in text order: one less for each step from the last sample.
    sample = np.full(n, -1, np.int64)
    sample[here] = match + here
    last = np.zeros(n, np.int64)
    last[here] = here
    last = np.maximum.accumulate(last)
    long = sample[last] - np.arange(n) >= WINDOW
    # Suffixes that share WINDOW bytes stand together; a window ends before its segment's border.
    heads = np.flatnonzero(~long[order])
    sound = room[order] >= WINDOW
    first = np.minimum.reduceat(np.where(sound, order, n), heads)
    out = np.arange(n)
    out[order[sound]] = np.repeat(first, np.diff(np.append(heads, n)))[sound]
    return out, segment


ANCHOR = "h long, around long, key long, place long, copy boolean"
#: Anchors that a task holds to tell copies from the first of them before the shuffle.
HELD_ANCHORS = 1_000_000


def place_key() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)) - F.pmod(F.xxhash64("text"), F.lit(2**62)))


def anchor_batch(columns: list[np.ndarray], copy: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), copy))], ["h", "around", "key", "place", "copy"])


def find_anchors(docs: DataFrame) -> DataFrame:
    """The anchors of all documents. Of equal surroundings that a task meets, all but the first are copies whatever
    other tasks have, so a passage that stands in very many documents comes to the shuffle a few times a task."""

    def run(batches):
        held, size = [], 0

        def told():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.lexsort(columns[::-1])
            h, around, key, place = columns = [c[order] for c in columns]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (around[1:] != around[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = ~new & ((key != key[first]) | (place != place[first]))
            yield anchor_batch([c[~copy] for c in columns], False)
            if copy.any():
                yield anchor_batch([c[copy] for c in columns], True)

        for part in slices(batches, 1, PIECE):
            key = part.column(0).to_numpy()
            for text, place, h, around in anchor_rows(utf8(part.column(1))):
                if len(text):
                    held.append((h.view(np.int64), around.view(np.int64), key[text], place))
                    size += len(text)
            if size > HELD_ANCHORS:
                yield from told()
                held, size = [], 0
        if held:
            yield from told()

    return docs.select(place_key().alias("key"), "text").mapInArrow(frugal(run), ANCHOR)


def repeated_anchors(found: DataFrame) -> DataFrame:
    """Anchors with what they are: a copy of equal surroundings, or the first of its surroundings
    where the anchor has others too. One pass over sorted rows that holds one row; copies that their
    task has told already are dealt by themselves and pass."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.when(F.col("copy"), F.xxhash64("key", "place")).otherwise(F.col("h"))
    placed = found.repartition(parts, by).sortWithinPartitions("copy", "h", "around", "key", "place")

    def run(batches):
        lead = None  # the first row of the current surroundings
        held, told = None, False  # the last first row, and whether another of its anchor stands before it
        for batch in batches:
            passed = batch.filter(batch.column(4))
            if passed.num_rows:
                yield passed
                batch = batch.filter(pc.invert(batch.column(4)))
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns[:4]]
            h, around, key, place = columns
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (around[1:] != around[:-1])])
            if lead is not None and (h[0], around[0]) == lead[:2]:
                new[0] = False
            starts = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            first_key = np.concatenate([[lead[2] if lead else 0], key[starts]])[of + 1]
            first_place = np.concatenate([[lead[3] if lead else 0], place[starts]])[of + 1]
            copy = ~new & ((key != first_key) | (place != first_place))
            if copy.any():
                yield anchor_batch([c[copy] for c in columns], True)
            if len(starts):
                lead = tuple(int(c[starts[-1]]) for c in columns)
                firsts = [c[starts] for c in columns]
                if held is not None:
                    firsts = [np.concatenate([[x], c]) for x, c in zip(held, firsts, strict=True)]
                same = firsts[0][1:] == firsts[0][:-1]
                many = np.concatenate([[told and held is not None], same]) | np.concatenate([same, [False]])
                if many[:-1].any():
                    yield anchor_batch([c[:-1][many[:-1]] for c in firsts], False)
                held, told = tuple(int(c[-1]) for c in firsts), bool(many[-1])
        if held is not None and told:
            yield anchor_batch([np.array([x], np.int64) for x in held], False)

    return placed.mapInArrow(frugal(run), ANCHOR)


FLAG = "key long, at long, around long, lo long, hi long"


def flags(key, at, around, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (key, at, around, lo, hi)], ["key", "at", "around", "lo", "hi"])


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def index_flags(segments: DataFrame) -> DataFrame:
    """Windows that an index finds earlier, group by group of whole anchors."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = segments.repartition(parts, "h").sortWithinPartitions("h")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > INDEX_BYTES:
                rows = pa.Table.from_batches(held)
                h = rows.column(0).to_numpy()
                whole = len(h) - int(np.argmax(h[::-1] != h[-1])) if h[0] != h[-1] else 0
                if whole:
                    yield from search(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from search(pa.Table.from_batches(held))

    def search(rows: pa.Table):
        _, around, key, place = (rows.column(i).to_numpy() for i in range(4))
        order = np.lexsort((place >> 14, key))
        around, key, place = around[order], key[order], place[order]
        segments = rows.column(4).take(pa.array(order)).to_pylist()
        lengths = np.array(list(map(len, segments)), np.int64)
        first, segment = earliest_windows(np.frombuffer(b"".join(segments), np.uint8), lengths)
        again = first < np.arange(len(first))
        # texts that share a doc_id do not repeat each other at equal offsets
        hit = np.flatnonzero(again)
        hit = hit[key[segment[hit]] == key[segment[first[hit]]]]
        begin = unpack(place)[1] - (np.cumsum(lengths + 1) - lengths - 1)
        again[hit[begin[segment[hit]] + hit == begin[segment[first[hit]]] + first[hit]]] = False
        a, b = runs_of(again)  # a run ends before the last WINDOW symbols of its segment
        if len(a):
            of = segment[a]
            start = (np.cumsum(lengths + 1) - lengths - 1)[of]
            at, lo, _ = unpack(place[of])
            yield flags(key[of], at, around[of], lo + a - start, lo + b - start)

    return placed.mapInArrow(frugal(run), FLAG)


def hot_flags(segments: DataFrame) -> DataFrame:
    """The same for anchors with very many surroundings: single windows, reduced to their first place before the
    shuffle. All but those first places are repeats; they part by window and place, so no window is one task's."""

    def windows(batches):
        for part in slices(batches, 4, PIECE):
            lengths = np.array([len(x) for x in part.column(4).to_pylist()], np.int64)
            data = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
            at, lo, hi = unpack(part.column(3).to_numpy())
            n = hi - lo + 1
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(np.cumsum(lengths) - lengths, n) + inside
            there, back = Rolling(data).grams(WINDOW)[start], Rolling(data[::-1]).grams(WINDOW)[len(data) - WINDOW - start]
            key, around = part.column(2).to_numpy(), part.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (there.view(np.int64), back.view(np.int64), key[row], at[row], around[row], lo[row] + inside)], ["w1", "w2", "key", "at", "around", "lo"])

    rows = segments.mapInArrow(frugal(windows), "w1 long, w2 long, key long, at long, around long, lo long")
    first = rows.groupBy("w1", "w2").agg(F.min(F.struct("key", "lo")).alias("first")).select("w1", "w2", F.col("first.key").alias("key"), F.col("first.lo").alias("lo"))
    return rows.join(first, ["w1", "w2", "key", "lo"], "left_anti").select("key", "at", "around", "lo", F.col("lo").alias("hi"))


def around_of(text: bytes, at: int) -> int:
    """The hash of an anchor's surroundings, as find_anchors has it."""
    left, right = max(0, at - (WINDOW - GRAM)), min(len(text), at + WINDOW)
    data = np.frombuffer(text[left:right], np.uint8)
    h = Rolling(data)(np.array([0]), np.array([len(data)]))
    return int(Rolling.mixed(h + np.array([(at - left) << 8 | right - at], np.uint64)).view(np.int64)[0])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, the removed spans and the bytes that are left."""
    _, size = text_bytes(docs)
    blocks = parts_for(size, BLOCK_BYTES, 8)
    noted = materialize(repeated_anchors(find_anchors(docs)), "repeat-anchors")
    hot = noted.filter("not copy").groupBy("h").count().filter(F.col("count") > HOT).select("h", F.lit(True).alias("hot"))

    dealt = docs.select(place_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    asked = noted.filter("not copy").join(hot, "h", "left").select(block, "h", "around", "key", "place", F.coalesce("hot", F.lit(False)).alias("hot"))

    def cut(key, texts: pa.Table, own: pa.Table) -> pa.Table:
        places: dict[int, list[tuple]] = {}
        for h, around, k, place, is_hot in zip(*(own.column(c).to_pylist() for c in ("h", "around", "key", "place", "hot")), strict=True):
            places.setdefault(k, []).append((h, around, k, place, is_hot))
        out, seen, keys = [], set(), texts.column("key").to_pylist()
        several = {k for k, n in Counter(keys).items() if n > 1}
        for k, text in zip(keys, utf8(texts.column("text")), strict=True):
            for row in places.get(k, ()):
                at, lo, hi = (int(x) for x in unpack(np.int64(row[3])))
                # of rows that share a doc_id, one text with these surroundings gives the segment, once
                if hi + WINDOW <= len(text) and (k not in several or row[1:4] not in seen and around_of(text, at) == row[1]):
                    if k in several:
                        seen.add(row[1:4])
                    out.append((*row, text[lo : hi + WINDOW]))
        h, around, k, place, is_hot, segment = zip(*out, strict=True) if out else ((),) * 6
        return pa.table({"h": pa.array(h, pa.int64()), "around": pa.array(around, pa.int64()), "key": pa.array(k, pa.int64()), "place": pa.array(place, pa.int64()), "segment": pa.array(segment, pa.binary()), "hot": pa.array(is_hot, pa.bool_())})

    segments = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(cut, "h long, around long, key long, place long, segment binary, hot boolean")
    segments = materialize(segments, "repeat-segments")
    plain = ["h", "around", "key", "place", "segment"]
    at = F.shiftright("place", 14)
    copies = noted.filter("copy").select("key", at.alias("at"), "around", (at - F.shiftright("place", 7).bitwiseAND(F.lit(127))).alias("lo"), (at - F.col("place").bitwiseAND(F.lit(127))).alias("hi"))
    found = copies.unionByName(index_flags(segments.filter("not hot").select(*plain))).unionByName(hot_flags(segments.filter("hot").select(*plain)))
    found = found.withColumn("block", block)

    def remove(key, texts: pa.Table, own: pa.Table) -> pa.Table:
        keys = texts.column("key").to_pylist()
        twice = len(set(keys)) < len(keys)
        k, at, around, lo, hi = (own.column(c).to_numpy() for c in ("key", "at", "around", "lo", "hi"))
        order = np.argsort(k, kind="stable")
        k, at, around, lo, hi = (c[order] for c in (k, at, around, lo, hi))
        spans, kept, sizes = [], [], []
        for own_key, text in zip(keys, utf8(texts.column("text")), strict=True):
            a, b = np.searchsorted(k, own_key, "left"), np.searchsorted(k, own_key, "right")
            x, y = lo[a:b], hi[a:b]
            if twice and b > a:  # another row may have this doc_id: keep the marks of this text
                mine = np.array([t + GRAM <= len(text) and around_of(text, int(t)) == r for t, r in zip(at[a:b], around[a:b], strict=True)], bool)
                x, y = x[mine], y[mine]
            sizes.append(len(text))
            if not len(x):
                spans.append([])
                kept.append(text)
                continue
            marks = np.zeros(len(text) + 1, np.int64)
            np.add.at(marks, x, 1)
            np.add.at(marks, y + WINDOW, -1)
            gone = np.cumsum(marks[:-1]) > 0
            first, last = runs_of(gone)
            spans.append([{"start": s, "end": e + 1} for s, e in zip(first.tolist(), last.tolist(), strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
