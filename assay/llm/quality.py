"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on the statistics of labelled training documents. Every path
from a root to a node becomes a conjunctive rule; equal rules count once. Lasso logistic
regression weights the rules, most of them with zero, and what is left is compiled into one
Spark column expression over the statistics.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1; labels, language,
source and doc_id are never inputs of a score. Null and "" have the statistics of a text without
words. Null labels are not learned from; labels of repeated documents count for each row.
Without labels of both kinds the score is constant: 0.5 without any, else that kind's share.
Repeated rows are scored each for itself; extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import fresh, frugal, give_back, id_filter, materialize, slices, utf8

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "mark_share", "symbol_share", "wide_share", "space_share",
    "distinct_share", "top_share", "stutter_share", "bare_share", "shout_share", "end_mark_share", "line_words", "line_distinct_share", "full_stop_share", "long_word_share", "pair_distinct_share",
)
FOLDS, TEST_FOLD = 3, 1
#: Labelled rows to learn from; beyond it a share of them, chosen by a hash of their ids, labels and statistics.
TRAIN_ROWS = 500_000
#: Partitions of the rows that the trees and weights are fitted on.
TRAIN_PARTS = 4

UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
LETTERS = UPPER + bytes(range(0x61, 0x7B))
WIDE = bytes(range(0x80, 0x100))
SPACE = b" \t\n\r\x0b\x0c"
MARKS = b".,;:!?'\"()-"
SYMBOLS = bytes(b for b in range(0x21, 0x7F) if b not in MARKS + LETTERS + DIGITS)


def measure(text: bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of FEATURES."""
    n = len(text)
    count = lambda some: n - len(text.translate(None, some))
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, digits, marks, symbols, wide, space = map(count, (UPPER, DIGITS, MARKS, SYMBOLS, WIDE, SPACE))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    alpha = count(LETTERS)
    share = lambda x, of: x / of if of else 0.0
    return (
        math.log1p(n), math.log1p(k), share(n - space, k), share(upper, alpha), share(digits, n), share(marks, n), share(symbols, n), share(wide, n), share(space, n),
        share(len(seen), k), share(max(seen.values(), default=0), k), share(sum(map(bytes.__eq__, words, words[1:])), k),
        share(sum(not w.isalnum() and not w.strip(SYMBOLS + MARKS) for w in words), k), share(text.count(b"!!"), k), share(sum(w[-1:] in b".,;:!?" for w in words), k),
        share(k, len(lines)), share(len(set(lines)), len(lines)), share(sum(x.rstrip()[-1:] in b".!?" for x in lines), len(lines)), share(sum(len(w) > 20 for w in words), k), share(len(set(zip(words, words[1:], strict=False))), k),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document. Narrow."""

    def run(batches):
        for part in slices(batches, 1):
            rows = np.array([measure(t) for t in utf8(part.column(1))], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *FEATURES])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True, order=True)
class Rule:
    """A conjunction: each statistic named lies in (over, upto]."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, of=F.col) -> Column:
        tests = [t for name, over, upto in self.bounds for t in ((of(name) > over) if over > -math.inf else None, (of(name) <= upto) if upto < math.inf else None) if t is not None]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass(frozen=True)
class Ensemble:
    """Score: logistic function of the bias and the weights of the rules that hold."""

    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self, of=F.col) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


CONDITION = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)")


def tree_rules(printed: str) -> set[Rule]:
    """The paths to all nodes below the root of a printed tree; the indentation is the depth."""
    rules, path = set(), []
    for line in printed.splitlines():
        if m := CONDITION.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, FEATURES[int(m[3])], m[4], float(m[5])))
            bounds: dict[str, list[float]] = {}
            for _, name, sign, value in path:
                b = bounds.setdefault(name, [-math.inf, math.inf])
                if sign == ">":
                    b[0] = max(b[0], value)
                else:
                    b[1] = min(b[1], value)
            rules.add(Rule(tuple(sorted((name, *b) for name, b in bounds.items()))))
    return rules


def training(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows outside the test fold: their label and statistics, and the id that tells copies apart where
    ``fit`` chooses and orders rows."""
    marks = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled"), F.when(F.col("quality") > 0, 1.0).otherwise(0.0).alias("label"))
    rows = stats.join(marks, stats.doc_id == marks.labelled).filter(f"crc32(cast(doc_id as string)) % {FOLDS} != {TEST_FOLD}").select("labelled", "label", *FEATURES)
    return rows


def fit(train: DataFrame, trees: int = 16, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> Ensemble:
    """Grow the trees, take their rules and weight them, from at most about TRAIN_ROWS rows."""
    train = materialize(train, "quality-train")
    kinds = {row["label"]: row["count"] for row in train.groupBy("label").count().collect()}
    total = sum(kinds.values())
    if len(kinds) < 2:
        share = next(iter(kinds), 0.5)
        return Ensemble(0.0 if not kinds else (12.0 if share else -12.0), ())
    if total > TRAIN_ROWS:
        train = train.filter(F.pmod(F.xxhash64(*train.columns), F.lit(1 << 20)) < int(TRAIN_ROWS / total * (1 << 20)))
    # bagging follows partitions and the order in them: both are told by the rows alone, however the input lies or a lost task reruns
    train = train.repartition(TRAIN_PARTS, *train.columns).sortWithinPartitions(*train.columns)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=48, minInstancesPerNode=5, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=seed).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        p = kinds.get(1.0, 0) / total
        return Ensemble(math.log(p / (1 - p)), ())
    names = [f"rule_{i}" for i in range(len(rules))]
    held = train.select("label", *(r.column().cast("double").alias(n) for r, n in zip(rules, names, strict=True)))
    held = VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "features")
    model = LogisticRegression(maxIter=80, regParam=lasso, elasticNetParam=1.0, standardization=False).fit(held)
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w != 0.0))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    stats = materialize(statistics(docs), "quality-statistics")
    model = fit(training(stats, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == TEST_FOLD, F.lit(False))
    return stats.select("doc_id", held_out.alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    # the statistics of labelled documents alone, without a shuffle of their texts
    marks = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(id_filter(marks)("doc_id"))
    model = fit(training(statistics(labelled), labels))

    @F.arrow_udf(", ".join(f"{f} double" for f in FEATURES))
    def measured(texts: pa.Array) -> pa.Array:
        columns = np.array([measure(t) for part in slices(iter([pa.record_batch([texts], ["text"])]), 0) for t in utf8(part.column(0))], np.float64).reshape(-1, len(FEATURES)).T
        give_back()
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], FEATURES)

    (held,) = fresh(docs, "__statistics")
    kept = docs.withColumn(held, measured("text")).filter(model.column(lambda f: F.col(held)[f]) >= 0.5)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
