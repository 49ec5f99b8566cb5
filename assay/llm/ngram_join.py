"""N-gram Jaccard join with vertical partitioning.

The hashes of all word n-grams are cut by range into fragments, so many that two documents that link
differ in fewer than all of them. What a document has in one fragment, as a whole, is a key. Each document
shows its fullest fragments, as many as two documents that link must share one of; those that share no whole
fragment never meet, whatever single n-grams they have in common. Pairs are verified by overlaps counted per
fragment and summed per pair.

Documents with equal sets are one node. No group is expanded into its pairs: two rounds join
each node to one centre of its posting lists, and verified links contract them. In crowded lists,
further rounds let each component try the likeliest pair that leads out of it. A last round looks at
all pairs whose ends are still in different components. A node whose n-grams occur too seldom in other
components links with none of them and leaves its lists, so that texts around one common passage are not paired
with each other. The number of fragments that two nodes share leaves those that can link, and of near copies
of one centre their differences from it leave few. No link between components is lost.

A document's set has the distinct n-grams of its lower-cased (A-Z) words between ASCII white
space; fewer than n words are one n-gram; null and "" have none and link with nothing. Repeated
rows are documents of their own. A component's id is the smallest doc_id in it; null ids count
for nothing there. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import drop_tables, fresh, frugal, give_back, id_filter, materialize, slices, utf8

NGRAM = 4
LEAST, OF = 85, 100  # link: OF * intersection >= least * union, least being LEAST unless told otherwise
FRAGMENTS = 4  # in which overlaps are counted
#: Pairs left to try, within the bounds, for each entry of a posting list from which on more rounds of likely
#: pairs pay; they try TRIES of each component and end when fewer than one in YIELD links. These change what
#: the join costs, not its result.
CROWDED, TRIES, YIELD = 8, 8, 20
STEP_PAIRS = 500_000  # pairs of posting lists that are looked at together
SPREAD = 256  # links of one centre that one task verifies


class WordHashes(dict):
    """64-bit hashes of words, kept for the words that a task meets first."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


def sets_of(texts: list[bytes], n: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    get = hashes.__getitem__
    words = [t.lower().split() for t in texts]
    flat = np.fromiter((h for ws in words for h in map(get, ws)), np.uint64)
    step, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def mix(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            h = (h ^ p) * step
            h ^= h >> np.uint64(32)
        h *= odd
        return h ^ h >> np.uint64(29)

    grams = mix([flat[i : len(flat) - n + 1 + i] for i in range(n)]) if len(flat) >= n else None
    at = 0
    for ws in words:
        k = len(ws)
        if k >= n:
            yield np.unique(grams[at : at + k - n + 1])
        elif k:
            yield mix([flat[i : i + 1] for i in range(at, at + k)])
        else:
            yield np.empty(0, np.uint64)
        at += k


def apart_by(total, least: int):
    """The most n-grams that only one of two linked sets with so many n-grams together can have."""
    return (OF - least) * total // (OF + least)


def band(n):
    """Sets up to this size are cut alike: the next power of two, 4 at least."""
    return np.int64(1) << np.maximum(np.frexp(np.asarray(n) - 1)[1], 2).astype(np.int64)


def shown(n, top, least: int):
    """How many fragments a set of n shows in the band up to ``top``. Each fragment in which two sets differ takes an
    n-gram that only one has, so of any order of fragments they share one among the first so many."""
    return apart_by(n + np.minimum(top, OF * n // least), least) + 1


def keys(s: np.ndarray, least: int) -> np.ndarray:
    """The keys of the fragments that a set shows: in its own band, and in the next if a linked set can be there.
    Fuller fragments come first, for they are seldom equal by chance. A set that links only with equal ones has none."""
    n, out = len(s), []
    far = OF * n // least
    if not n or not apart_by(n + far, least):
        return np.empty(0, np.uint64)
    odd, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def key(part: np.ndarray, sums: np.ndarray, top: int) -> np.ndarray:
        h = (sums ^ np.uint64(top)) * odd + part
        h = (h ^ h >> np.uint64(32)) * step
        return h ^ h >> np.uint64(29)

    top, last = int(band(n)), int(band(far))
    if not apart_by(n + min(top, far), least):  # those of its own band that it links with are equal
        top *= 2
    while top <= last:
        m, p = apart_by(2 * top, least) * 6 // 5 + 1, int(shown(n, top, least))
        part = s // np.uint64(2**64 // m + 1)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        found = key(part[start], np.add.reduceat(s, start), top)
        out.append(found[np.lexsort((found, -np.diff(np.append(start, n))))[:p]])
        if len(found) < p:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[start])
            out.append(np.sort(key(empty, np.zeros(len(empty), np.uint64), top))[: p - len(found)])
        top *= 2
    return np.concatenate(out)


def describe(docs: DataFrame, n: int, least: int) -> DataFrame:
    """Per row: doc_id, size and node of its set, and its keys unless the task has shown them already."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        hashes = WordHashes()
        for part in slices(batches, 1):
            sizes, nodes, shows = [], [], []
            for s in sets_of(utf8(part.column(1)), n, hashes):
                node = None if not len(s) else xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63
                fresh = len(s) > 0 and (node, len(s)) not in seen
                if fresh:
                    seen.add((node, len(s)))
                sizes.append(len(s))
                nodes.append(node)
                shows.append(keys(s, least).view(np.int64) if fresh else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(shows, pa.list_(pa.int64()))], ["doc_id", "n", "node", "keys"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), "doc_id long, n int, node long, keys array<long>")


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole posting lists from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and keys[-1] == held[-1].column(0)[-1].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        held.append(batch.slice(0, cut))
        yield tuple(c.to_numpy() for c in pa.Table.from_batches(held).columns)
        held = [batch.slice(cut)]
    if held:
        yield tuple(c.to_numpy() for c in pa.Table.from_batches(held).columns)


def posting_lists(sets: DataFrame) -> DataFrame:
    """Entries of the lists with two nodes or more, each with its list's size."""
    entries = sets.filter("keys is not null").select(F.explode("keys").alias("key"), "node", "n")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for key, node, n in lists(batches):
            if not len(key):
                continue
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node, n = key[first], node[first], n[first]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            size = np.repeat(size, size)
            yield pa.RecordBatch.from_arrays([pa.array(c[size > 1]) for c in (key, node, n, size)], ["key", "node", "n", "size"])

    return entries.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(frugal(run), "key long, node long, n int, size long")


PAIR = "a long, b long, na int, nb int"


def star_pairs(postings: DataFrame) -> DataFrame:
    """Each node with the centres of its lists, and in how many lists they meet. A list's centre is the node that
    meets most others over all its lists; of near copies that is the one with the fewest changes of its own."""
    weight = postings.groupBy("node").agg(F.sum("size").alias("weight"))
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = postings.join(weight, "node").select("key", "node", "n", "weight").repartition(parts, "key").sortWithinPartitions("key", F.desc("weight"), "node")

    def run(batches):
        for key, node, n, _ in lists(batches):
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            centre = np.repeat(start, np.diff(np.append(start, len(key))))
            some = node != node[centre]
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (node[centre], node, n[centre], n)], ["a", "b", "na", "nb"])

    return placed.mapInArrow(frugal(run), PAIR).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("lists"))


def nearest_centres(stars: DataFrame) -> DataFrame:
    """One pair for each node: with the centre that it meets most often. A group of near copies so
    costs one pair for each member, however many lists they share."""
    best = F.max(F.struct("lists", F.bitwise_not("a").alias("least"), "na", "nb")).alias("best")
    return stars.groupBy("b").agg(best).select(F.bitwise_not(F.col("best.least")).alias("a"), "b", "best.na", "best.nb")


def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def mixed_lists(postings: DataFrame, component: DataFrame) -> DataFrame:
    """Entries, with their component, of the lists that have nodes of several components."""
    kept = [c for c in postings.columns if c not in ("size", "component")]
    placed = postings.select(*kept).join(component, "node", "left").select(*kept, F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def likely_pairs(mixed: DataFrame, seed: int, tried: DataFrame, least: int) -> DataFrame:
    """For each component some pairs of most common lists with a node of another: every list offers its
    first node in an order that each round draws anew."""
    order = F.xxhash64("node", F.lit(seed))
    offer = mixed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n", "component")).alias("c"))
    met = mixed.join(offer, "key").filter("component != c.component")
    turn = F.col("node") > F.col("c.node")
    both = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"), F.when(turn, F.col("c.n")).otherwise(F.col("n")).alias("na"), F.when(turn, F.col("n")).otherwise(F.col("c.n")).alias("nb"), F.col("component").alias("x"), F.col("c.component").alias("y"))
    pairs = both.filter(OF * F.least("na", "nb") >= least * F.greatest("na", "nb")).groupBy("a", "b", "na", "nb", "x", "y").agg(F.count(F.lit(1)).alias("lists")).join(tried, ["a", "b"], "left_anti")
    sides = pairs.select("a", "b", "na", "nb", "lists", F.explode(F.array("x", "y")).alias("side"))
    best = sides.groupBy("side", F.pmod(F.xxhash64("a", "b"), F.lit(TRIES))).agg(F.max_by(F.struct("a", "b", "na", "nb"), F.struct("lists", F.xxhash64("a", "b"))).alias("p"))
    return best.select("p.*").distinct()


def crossing(columns: tuple[np.ndarray, ...], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the pairs of one list that are in different components and that can link, each once, in steps of bounded
    size, and how many lists such a pair must share. Entries are sorted by key and size. Only those outside their
    list's largest component look for partners.

    A pair has no more n-grams in common than either end shares with other components, which also leaves an end fewer
    sizes to look through. Two nodes with the same centre differ at least in what each added to it, but for what both added, and by the
    difference of what they lack. If that leaves no link without a common addition, they meet in lists of additions alone."""
    key, _, n, comp, shared, pivot, add, cut, kind = columns
    n, shared, add, cut = (c.astype(np.int64) for c in (n, shared, add, cut))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    of, start = np.cumsum(new) - 1, np.flatnonzero(new)
    by = np.lexsort((comp, of))
    run = np.flatnonzero(np.concatenate([[True], (of[by][1:] != of[by][:-1]) | (comp[by][1:] != comp[by][:-1])]))
    length = np.diff(np.append(run, len(by)))
    # the last of a list's runs by length is its largest component
    largest = np.lexsort((length, of[by][run]))
    last = np.concatenate([of[by][run][largest][1:] != of[by][run][largest][:-1], [True]])
    major = comp[by][run][largest][last]
    at = of << 32 | n
    lone = np.flatnonzero(comp != major[of])
    lo = np.searchsorted(at, of[lone] << 32 | -(-least * n[lone] // OF), "left")
    far = np.minimum(OF * n[lone] // least, (OF + least) * shared[lone] // least - n[lone])
    hi = np.maximum(np.searchsorted(at, of[lone] << 32 | np.maximum(far, 0), "right"), lo)
    ends = np.cumsum(hi - lo)
    for step in np.split(np.arange(len(lone)), np.searchsorted(ends, np.arange(STEP_PAIRS, ends[-1] if len(ends) else 0, STEP_PAIRS))):
        wide = hi[step] - lo[step]
        i = np.repeat(lone[step], wide)
        j = np.repeat(lo[step] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        ok = (comp[i] != comp[j]) & ((i < j) | (comp[j] == major[of[j]])) & ((OF + least) * shared[j] >= least * (n[i] + n[j]))
        i, j = i[ok], j[ok]
        d = apart_by(n[i] + n[j], least)
        short = np.where(pivot[i] == pivot[j], add[i] + add[j] + np.abs(cut[i] - cut[j]) - d, 0)
        top = band(np.maximum(n[i], n[j]))
        fragments = np.minimum(shown(n[i], top, least), shown(n[j], top, least)) - d
        ok = (short > 0) == (kind[i] > 0)
        yield i[ok], j[ok], np.where(kind[i] > 0, (short + 1) // 2, fragments)[ok]


def by_size(mixed: DataFrame, centred: DataFrame, additions: DataFrame) -> DataFrame:
    """The entries of the lists of fragments (kind 0) and, for the same nodes, of additions (kind 1). A node without a
    centre is its own."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = [F.coalesce("centre", "node").alias("centre"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("lacks", F.lit(0)).alias("lacks")]
    fragments = mixed.join(centred, "node", "left").select("key", "node", "n", "component", "shared", *told, F.lit(0).alias("kind"))
    nodes = mixed.select("node", "n", "component", "shared").distinct().join(centred, "node")
    more = additions.join(nodes, ["node", "centre"]).select(F.xxhash64("centre", "gram").alias("key"), "node", "n", "component", "shared", "centre", "added", "lacks", F.lit(1).alias("kind"))
    return fragments.unionByName(more).repartition(parts, "key").sortWithinPartitions("key", "kind", "n", "node")


def left_to_try(entries: DataFrame, least: int) -> int:
    """How many pairs crossing_pairs would look at, each list for itself; none is kept."""

    def run(batches):
        total = sum(len(i) for columns in lists(batches) if len(columns[0]) for i, _, _ in crossing(columns, least))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return int(entries.mapInArrow(frugal(run), "n long").agg(F.sum("n")).first()[0] or 0)


def crossing_pairs(entries: DataFrame, least: int) -> DataFrame:
    """Pairs of nodes in different components that the number of lists they share leaves as possible links.

    Of two nodes, what the one that shows less far shares with the other is what both show, so all other fragments
    that are equal stand after those it shows. Sets that meet in a second band have lists to spare."""

    def run(batches):
        for columns in lists(batches):
            if not len(columns[0]):
                continue
            node, n, kind = columns[1], columns[2], columns[8]
            held, size = [], 0
            for i, j, need in crossing(columns, least):
                held.append(np.stack([node[i], node[j], n[i], n[j], need, kind[i]]))
                size += len(i)
                if size > 200_000:
                    yield emit(held)
                    held, size = [], 0
            if held:
                yield emit(held)

    def emit(held):
        a, b, na, nb, need, kind = np.concatenate(held, axis=1)
        turn = a > b
        a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
        by = np.lexsort((kind, b, a))
        a, b, na, nb, need, kind = (c[by] for c in (a, b, na, nb, need, kind))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])]) if len(a) else [])
        met = np.diff(np.append(first, len(a)))
        small = [pa.array(c.astype(np.int32)) for c in (na[first], nb[first], need[first], met)]
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), *small], ["a", "b", "na", "nb", "need", "lists"])

    met = entries.mapInArrow(frugal(run), f"{PAIR}, need int, lists int").groupBy("a", "b", "na", "nb", "need").agg(F.sum("lists").alias("lists"))
    return met.filter("lists >= need").select("a", "b", "na", "nb").distinct()


def holders_of(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """node, holder: of each node in the column "of" the smallest doc_id of a document that has its set."""
    return sets.filter("node is not null").select("doc_id", "node").join(wanted, F.col("node") == F.col("of"), "left_semi").groupBy("node").agg(F.min("doc_id").alias("holder"))


def texts_of(cast: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text and the other columns of ``cast``. A holder's repeated rows all come, whatever their texts."""
    likely = id_filter(cast.select(F.col("holder").alias("id")))
    plain = docs.selectExpr("cast(doc_id as long) doc_id", "text").filter(likely("doc_id"))
    return plain.join(cast.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("holder"))).select("node", "text", *[c for c in cast.columns if c not in ("holder", "node")])


def able(mixed: DataFrame, docs: DataFrame, sets: DataFrame, n: int, least: int) -> DataFrame:
    """node, shared: how many of a node's n-grams occur in other components of the lists, if a link needs no more.

    Components only grow together, so what is counted once stays an upper bound."""
    nodes = mixed.select("node", "component").distinct()
    cast = materialize(nodes.join(holders_of(nodes.select(F.col("node").alias("of")), sets), "node").select("holder", "node", "component"), "ngram-able")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        hashes = WordHashes()
        for part in slices(batches, 1):
            nodes, comps = part.column(0).to_numpy(), part.column(2).to_numpy()
            found = list(sets_of(utf8(part.column(1)), n, hashes))
            # a repeated doc_id can have another text
            found = [s if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 == nodes[i] else s[:0] for i, s in enumerate(found)]
            size = [len(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(nodes, size)), pa.array(np.repeat(comps, size))], ["gram", "node", "component"])

    def count(batches):
        for gram, node, comp in lists(batches):
            if not len(gram):
                continue
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            far = np.repeat(np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start), np.diff(np.append(start, len(gram))))
            once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
            some, k = np.unique(node[far & once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(k.astype(np.int64))], ["node", "shared"])

    grams = texts_of(cast, docs).mapInArrow(frugal(cut), "gram long, node long, component long")
    met = grams.repartition(parts, "gram").sortWithinPartitions("gram", "node").mapInArrow(frugal(count), "node long, shared long")
    sizes = mixed.select("node", "n").distinct()
    told = met.groupBy("node").agg(F.sum("shared").cast("int").alias("shared")).join(sizes, "node").filter(OF * F.col("shared") >= least * F.col("n"))
    told = materialize(told.select("node", "shared"), "ngram-shared")
    drop_tables(docs.sparkSession, cast)
    return told


def linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that link: fragment overlaps, counted apart and summed per pair. Also the overlaps, with what b has
    in the fragment and a has not."""
    centres = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    # a centre's links are dealt over several tasks, with the centre's fragments in each
    tasks = F.ceil(F.col("links") / SPREAD).cast("int")
    spread = pairs.join(centres, "a").select("a", "b", F.pmod(F.hash("b"), tasks).cast("int").alias("task"))
    roles = spread.select(F.col("b").alias("of"), "a", "task", F.lit(1).alias("role"), F.col("b").alias("member")).unionByName(
        centres.select(F.col("a").alias("of"), "a", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.lit(0).alias("role"), F.col("a").alias("member"))
    )
    holders = holders_of(roles.select("of").distinct(), sets)
    # roles meet their documents' ids before any text moves
    cast = materialize(roles.join(holders, F.col("node") == F.col("of")).select("holder", "node", "a", "task", "role", "member"), "ngram-roles")

    def cut(batches):
        hashes = WordHashes()
        for part in slices(batches, 1):
            nodes, out = part.column(0).to_pylist(), []
            held: dict[bytes, tuple[int | None, list[bytes]]] = {}
            for i, text in enumerate(utf8(part.column(1))):
                if text not in held:
                    (s,) = sets_of([text], n, hashes)
                    at = np.searchsorted(s, np.array([f * (2**64 // FRAGMENTS) for f in range(1, FRAGMENTS)], np.uint64))
                    held[text] = xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None, [p.tobytes() for p in np.split(s, at)]
                node, pieces = held[text]
                if node == nodes[i]:  # a repeated doc_id can have another text
                    out += [(i, f, p) for f, p in enumerate(pieces)]
            if out:
                row, f, p = zip(*out, strict=True)
                roles = part.select(["a", "task", "role", "member"]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*roles.columns, pa.array(f, pa.int32()), pa.array(p, pa.binary())], ["a", "task", "role", "member", "fragment", "grams"])

    placed = texts_of(cast, docs).mapInArrow(frugal(cut), "a long, task int, role int, member long, fragment int, grams binary").select("a", "task", "fragment", "role", "member", "grams")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(parts, "a", "task", "fragment").sortWithinPartitions("a", "task", "fragment", "role", "member")

    def count(batches):
        key = centre = last = None
        for batch in batches:
            out = []
            for a, task, fragment, role, member, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(grams, np.uint64)
                if role == 0:
                    key, centre, last = (a, task, fragment), s, None
                elif key == (a, task, fragment) and member != last:
                    last = member
                    own = np.setdiff1d(s, centre, assume_unique=True)
                    out.append((a, member, len(s) - len(own), own.view(np.int64)))
            if out:
                a, b, k, own = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["a", "b", "common", "own"])

    columns = "a long, b long, common long, own array<long>"
    overlaps = materialize(placed.mapInArrow(frugal(count), columns), "ngram-overlaps")
    common = pairs.join(overlaps.groupBy("a", "b").agg(F.sum("common").alias("common")), ["a", "b"])
    links = materialize(common.filter(f"{OF} * common >= {least} * (na + nb - common)").select("a", "b"), "ngram-links")
    drop_tables(docs.sparkSession, cast)
    return links, overlaps


def around_centres(pairs: DataFrame, overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each node b that has half of its set in common with its centre a: how many n-grams it added and how many it
    lacks; and those that it added."""
    common = overlaps.groupBy("a", "b").agg(F.sum("common").alias("common"))
    near = pairs.join(common, ["a", "b"]).filter("2 * common >= nb").select(F.col("b").alias("node"), F.col("a").alias("centre"), F.expr("cast(nb - common as int)").alias("added"), F.expr("cast(na - common as int)").alias("lacks"))
    near = materialize(near, "ngram-centred")
    own = overlaps.select(F.col("b").alias("node"), F.col("a").alias("centre"), F.explode("own").alias("gram"))
    return near, materialize(own.join(near.select("node", "centre"), ["node", "centre"], "left_semi"), "ngram-additions")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every linked node: labels fall to the least neighbour's
    and then to their label's own, until none falls."""
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        fell = labels.join(near, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        step = fell.join(labels.select(F.col("node").alias("via"), F.col("component").alias("jump")), "via").select("node", F.least("via", "jump").alias("component"), (F.least("via", "jump") < F.col("was")).alias("fell"))
        step = materialize(step, "labels")
        done = step.filter("fell").isEmpty()
        drop_tables(edges.sparkSession, labels)
        labels = step.select("node", "component")
        if done:
            drop_tables(edges.sparkSession, edges)
            return labels


def classes(docs: DataFrame, n: int = NGRAM, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, size and node of its set, and the class of linked nodes (null without n-grams)."""
    spark = docs.sparkSession
    shows = materialize(describe(docs, n, least), "ngram-shows")
    postings = materialize(posting_lists(shows), "ngram-postings")
    sets = materialize(shows.select("doc_id", "n", "node"), "ngram-sets")
    drop_tables(spark, shows)
    stars = materialize(star_pairs(postings), "ngram-stars")
    tried = links = component = around = None

    def step(asked: DataFrame) -> bool:
        """Verify pairs; whether enough of them link for more such rounds to pay."""
        nonlocal tried, links, component, around
        pairs = materialize(asked, "ngram-pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        if pairs.isEmpty() and component is not None:
            return False
        found, overlaps = linked(pairs, docs, sets, n, least)
        around = around or around_centres(pairs, overlaps)
        drop_tables(spark, overlaps)
        if links is not None and found.isEmpty():
            return False
        links = found if links is None else links.unionByName(found)
        if component is not None:
            drop_tables(spark, component)
        component = components(links)
        return found.count() * YIELD >= pairs.count()

    step(nearest_centres(stars))
    step(nearest_centres(apart(stars, component).join(tried, ["a", "b"], "left_anti")))
    mixed, seed, more = materialize(mixed_lists(postings, component), "ngram-mixed"), 0, True
    drop_tables(spark, stars, postings)
    told = able(mixed, docs, sets, n, least)
    before, mixed = mixed, materialize(mixed_lists(mixed.join(told, "node"), component), "ngram-mixed")
    drop_tables(spark, before, told)
    # while the pairs left are many for the entries they come from, each component tries its likeliest one
    while more and left_to_try(by_size(mixed, *around), least) > CROWDED * mixed.count():
        seed += 1
        more = step(likely_pairs(mixed, seed, tried, least))
        before, mixed = mixed, materialize(mixed_lists(mixed, component), "ngram-mixed")
        drop_tables(spark, before)
    step(crossing_pairs(by_size(mixed, *around), least).join(tried, ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
    drop_tables(spark, mixed, *around)
    return sets.select("doc_id", "n", "node").join(component, "node", "left").select("doc_id", "n", "node", F.coalesce("component", "node").alias("class"))


def join_components(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    placed = classes(docs, n)
    least = placed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "class", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = NGRAM, least: int = LEAST) -> DataFrame:
    """The documents with one left of each group of linked ones: that with the smallest doc_id, and of
    rows that share it the smallest text. Documents without n-grams all stay, as do all columns.

    Only documents whose doc_id may be one of a document that goes, or that stands twice, are looked at
    again; no other text is shuffled.
    """
    placed = materialize(classes(docs, n, least), "ngram-classes").filter("class is not null")
    chosen = placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("of"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("node") == F.col("of.node")))
    losers = placed.join(chosen, "class").filter(other).select(F.col("doc_id").alias("__id"), F.col("node").alias("__of")).distinct()
    losers = materialize(losers, "ngram-losers")
    twice = materialize(placed.groupBy("doc_id", "node").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("node").alias("__of")), "ngram-twice")
    may_be = id_filter(losers.unionByName(twice).select(F.col("__id").alias("id")))

    @F.arrow_udf("long")
    def node_of(texts: pa.Array) -> pa.Array:
        out, hashes = [], WordHashes()
        for text in utf8(texts):
            (s,) = sets_of([text], n, hashes)
            out.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
        give_back()
        return pa.array(out, pa.int64())

    plain = [F.col(f"`{c}`") for c in docs.columns]
    mark, node, lost_id, lost_node = fresh(docs, "__may_be", "__node", "__lost_id", "__lost_node")
    marked = docs.withColumn(mark, may_be(F.col("doc_id").cast("long")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(lost_id)) & (F.col(node) == F.col(lost_node))
    told = lambda df: df.select(F.col("__id").alias(lost_id), F.col("__of").alias(lost_node))
    kept = marked.filter(F.col(mark)).select(*plain, node_of("text").alias(node)).join(told(losers), same, "left_anti")
    once = kept.join(told(twice), same, "left_anti")
    repeated = kept.join(told(twice), same, "left_semi").groupBy("doc_id", node).agg(F.min_by(F.struct(*plain), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return marked.filter(~F.col(mark)).select(*plain).union(once.select(*plain)).union(repeated)
