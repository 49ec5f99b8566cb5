"""Source divergence audit by distinct sparse count vectors.

In each lang, a term's vector holds its occurrences in each source that has it. Terms of equal vectors
are one row with a multiplicity. A pair of sources is evaluated once for each distinct vector that both are
in; for vectors that only one of them is in, what the other adds depends on its size alone, so these are
summed by count and not by vector. So with s, t the shares of a term in two sources and s0, t0 those of an
absent term, the sum of f(s, t) over V terms is

    V f(s0, t0) + sum over vectors with s of f(s, t0) - f(s0, t0) + sum over vectors with t of f(s0, t) - f(s0, t0)
    + sum over vectors with both of f(s, t) - f(s, t0) - f(s0, t) + f(s0, t0).

Nothing is estimated: shares are 1 + floor(SCALE * (count + 2) / (N + 2 V)), f is floor((s - t)^2 / (s + t)),
all in whole numbers. Terms are ranked one by one and not by vector.

Terms are runs of A-Z, a-z and code points above U+007F, lower-cased A-Z. A null text, lang or source is ""; a
lang keeps the terms of at least ``LEAST_DOCS`` of its rows, and repeated rows count again. A group whose lang
keeps no term has pairs of value 0 and no term rows; a lang of one source has no pairs. Ties go to the smaller
item by UTF-8 bytes. Texts are read whole. Extra columns are not read. An empty table gives an empty result.
The result has a row for each two sources of a lang, and a vector has no more entries than these sources.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import frugal, materialize, slices, utf8

TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of groups that a task counts before it hands them on; a held number is occurrences + ROW * rows.
HELD_TERMS, ROW = 300_000, 1 << 40
#: Entries of vectors that are evaluated together.
STEP_ENTRIES = 1 << 18


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and rows of the group that have it."""

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def hand_on():
            for (lang, source), terms in held.items():
                both = np.fromiter(terms.values(), np.int64, len(terms))
                names = pa.array([lang], pa.string()), pa.array([source], pa.string())
                columns = [pa.DictionaryArray.from_arrays(np.zeros(len(terms), np.int32), x).dictionary_decode() for x in names]
                columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(both % ROW), pa.array(both // ROW)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for piece in slices(batches, 2):
            for lang, source, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), utf8(piece.column(2)), strict=True):
                terms = held.setdefault((lang, source), {})
                for term, n in Counter(TERM.findall(text.lower())).items():
                    terms[term] = terms.get(term, 0) + n + ROW
            if sum(map(len, held.values())) >= HELD_TERMS:
                yield from hand_on()
        yield from hand_on()

    parts = docs.mapInArrow(frugal(run), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in decimals since the product can pass 64 bits; null without terms."""
    n, total, terms = (c.cast("decimal(19,0)") for c in (n, total, terms))
    return F.when(terms > 0, F.call_function("div", (n + 2) * SCALE, total + 2 * terms) + 1)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def both_present(vectors: DataFrame) -> DataFrame:
    """lang, source, item, value (source before item): over vectors that both are in, what these add to what single
    entries tell. Sums stay within 64 bits: no f is above SCALE + 1 and a source's shares sum to about SCALE."""

    def run(batches):
        found: Counter[tuple[str, str, str]] = Counter()
        for b in batches:
            lang, times, entries = b.columns
            lang, times, flat = lang.dictionary_encode(), times.to_numpy(), entries.flatten()
            langs, lang = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            size = entries.value_lengths().to_numpy()
            start = np.cumsum(size) - size
            source, p, p0 = (flat.field(i) for i in range(3))
            source, p, p0 = source.dictionary_encode(), p.to_numpy(), p0.to_numpy()
            names, source = source.dictionary.to_pylist(), source.indices.to_numpy()
            wide = len(names)
            for code, name in enumerate(langs):
                total = np.zeros(wide * wide, np.int64)
                for k in np.unique(size[(lang == code) & (size > 1)]):
                    rows = np.flatnonzero((lang == code) & (size == k))
                    for some in np.array_split(rows, -(-len(rows) * k // STEP_ENTRIES)):
                        at = start[some, None] + np.arange(k)
                        s, a, a0, m = source[at].astype(np.int64), p[at], p0[at], times[some, None]
                        for i in range(k - 1):
                            x, x0, y, y0 = a[:, i : i + 1], a0[:, i : i + 1], a[:, i + 1 :], a0[:, i + 1 :]
                            more = (f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)) * m
                            np.add.at(total, (s[:, i : i + 1] * wide + s[:, i + 1 :]).ravel(), more.ravel())
                for pair in np.flatnonzero(total).tolist():
                    found[name, names[pair // wide], names[pair % wide]] += int(total[pair])
        columns = [pa.array([k[i] for k in found], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], ["lang", "source", "item", "value"])

    return vectors.select("lang", "times", "vector").mapInArrow(frugal(run), "lang string, source string, item string, value long")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: how far each source is from the others of its lang, and
    the terms that set it most apart from its lang."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = count_terms(docs)
    entry = F.struct("source", "n")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("vector"))
    kept = materialize(terms.filter(F.col("docs") >= LEAST_DOCS).drop("docs"), "divergence-kept")
    vectors = materialize(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")), "divergence-vectors")

    # every group with its size and the share of a term it has not; every lang with its number of terms and size
    spread = vectors.select("lang", "times", F.explode("vector").alias("e")).select("lang", "times", "e.source", "e.n")
    sizes = spread.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("size"))
    langs = vectors.groupBy("lang").agg(F.sum("times").alias("terms"), F.sum(F.col("times") * F.aggregate("vector", F.lit(0).cast("long"), lambda x, e: x + e["n"])).alias("lang_size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"))
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("size"), F.col("terms"))), "divergence-groups")

    # pairs: what absent terms give, what single entries give, what common ones give
    shares = spread.groupBy("lang", "source", "n").agg(F.sum("times").alias("times")).join(groups, ["lang", "source"]).select("lang", "source", "p0", "times", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    absent = groups.join(other, "lang").filter("source != item").select("lang", "source", "item", F.coalesce(F.col("terms") * divergence(F.col("p0"), F.col("q0")), F.lit(0).cast("long")).alias("value"))
    single = shares.join(other, "lang").filter("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q0")))).alias("value"))
    numbered = vectors.withColumn("id", F.monotonically_increasing_id())  # a step of its own: beside explode each entry would get a number
    placed = numbered.select("lang", "times", "id", F.explode("vector").alias("e")).select("lang", "times", "id", "e.source", "e.n").join(groups, ["lang", "source"])
    placed = placed.groupBy("id", "lang", "times").agg(F.sort_array(F.collect_list(F.struct("source", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), "p0"))).alias("vector"))
    half = materialize(single.unionByName(both_present(placed)), "divergence-pairs")
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = absent.unionByName(half).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))

    # terms of a group that has more of them than its lang
    own = kept.select("lang", "term", "total", F.explode("vector").alias("e")).select("lang", "term", "total", "e.source", "e.n").join(groups, ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"))
    told = own.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", place).filter(F.col("rank") <= TOP)
    return pairs.unionByName(told.select(pairs.columns))
