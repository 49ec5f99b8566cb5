"""Completion ledgers in Markdown (S15, W15, 2.9.1, 2.9.2, F17, P41): lines to gates, abandons, owned paths and problems.

A small function per file leaves out what stands in code fences. All else is done on rows: each line
is told by patterns, attribute lines belong to the last gate before them unless something between
has ended it, and each rule of the grammar is a filter over lines or gates.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.config import checkpointed
from assay.findings import together
from assay.functions.paths import normalized, path_problem
from assay.functions.text import expectation, trimmed
from assay.operators.ledger import gate_state

# The lines of the grammar.
GATE = r"^- \[( |x|X)\] (.*)\z"
ATTRIBUTE = r"^(\s+)(CHECK|EXPECT|EVIDENCE|CWD|DEPS):\s?(.*)\z"
UNINDENTED = r"^(CHECK|EXPECT|EVIDENCE|CWD|DEPS):"
ABANDON = r"^ABANDON:\s*(\S*)\s*(.*)\z"
INDENTED_ABANDON = r"^\s+ABANDON:"
OWNS = r"^OWNS:\s*(.*)\z"
GATE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
ATTRIBUTES = ("check", "expect", "evidence", "cwd", "deps")
OPEN, SHUT = re.compile(r" {0,3}(`{3,}|~{3,})(.*)"), re.compile(r" {0,3}(`+|~+)[ \t]*")


class Ledger(NamedTuple):
    """gates(file, line, id, title, checked, check, expect, evidence, cwd, deps, expectation, abandoned, reason,
    state, runnable); abandons(file, line, id, reason); owns(file, line, path); problems(file, line, rule, level, subject)."""

    gates: DataFrame
    abandons: DataFrame
    owns: DataFrame
    problems: DataFrame


def outside_fences(text: str) -> tuple[list[tuple[int, str]], bool]:
    """Numbered lines that are in no code fence, and whether a fence stays open."""
    kept, fence = [], ""
    for number, line in enumerate(re.split(r"\r?\n", text), 1):
        if fence:
            shut = SHUT.fullmatch(line)
            if shut and shut[1][0] == fence[0] and len(shut[1]) >= len(fence):
                fence = ""
        elif (opened := OPEN.fullmatch(line)) and not (opened[1][0] == "`" and "`" in opened[2]):
            fence = opened[1]
        else:
            kept.append((number, line))
    return kept, bool(fence)


LIVE = "struct<lines: array<struct<line: bigint, text: string>>, open: boolean>"


def live_lines(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        found = [outside_fences(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(kept) for kept, _ in found)])
        numbers, lines = pa.array([n for kept, _ in found for n, _ in kept], pa.int64()), pa.array([x for kept, _ in found for _, x in kept], pa.string())
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([numbers, lines], ["line", "text"]))
        return pa.StructArray.from_arrays([kept, pa.array([is_open for _, is_open in found], pa.bool_())], ["lines", "open"])

    return F.arrow_udf(run, LIVE)(text)


def is_pattern(sources: pa.Array) -> pa.Array:
    out = []
    for source in sources.to_pylist():
        try:
            re.compile(source or "")
            out.append(True)
        except re.error:
            out.append(False)
    return pa.array(out)


def told(files: DataFrame) -> DataFrame:
    """Live lines with their kind and gate (0: none), and a row of kind file before each file's: open if its fence stays open."""
    opened = files.select("file", live_lines(F.col("text")).alias("live"))
    own = F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit(None).cast("string").alias("text")))
    lines = opened.select("file", F.col("live.open").alias("open"), F.explode(F.concat(own, F.col("live.lines"))).alias("l")).select("file", "open", "l.line", "l.text")
    text = F.col("text")
    kind = (
        F.when(F.col("line") == 0, "file")
        .when(text.rlike(GATE), "gate")
        .when(text.rlike(INDENTED_ABANDON), "indented-abandon")
        .when(text.rlike(UNINDENTED), "unindented")
        .when(text.rlike(ATTRIBUTE), "attribute")
        .when(text.rlike(ABANDON), "abandon")
        .when(text.rlike(OWNS), "owns")
        .when(text.rlike(r"^#|^- "), "break")
    )
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("kind", kind).filter("kind is not null").withColumn("seen_gate", F.max(F.col("kind") == "gate").over(before))
    ends = F.when(F.col("kind") == "gate", F.col("line")).when(F.col("kind").isin("indented-abandon", "unindented", "abandon", "break") | ((F.col("kind") == "owns") & F.col("seen_gate")), F.lit(0))
    return marked.withColumn("gate", F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0)))


def listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), trimmed), lambda x: x != "")


def parse(files: DataFrame, need_gates: bool = True) -> Ledger:
    """Ledgers of files(file, text). The lines of the grammar are written once and read by every rule, as are the gates, each put
    together from its own line and its attributes' in one aggregation; rules about one line or gate share a pass."""
    lines = checkpointed(told(files))
    text, is_gate = F.col("text"), F.col("kind") == "gate"
    key, value = F.lower(F.regexp_extract("text", ATTRIBUTE, 2)), trimmed(F.regexp_extract("text", ATTRIBUTE, 3))
    attributes = lines.filter("kind = 'attribute'").select("file", "line", "gate", key.alias("key"), value.alias("value"))
    owned = attributes.filter("gate > 0")
    parts = lines.filter("gate > 0 and kind in ('gate', 'attribute')").select("file", "gate", "line", F.when(is_gate, text).alias("head"), F.when(~is_gate, key).alias("key"), F.when(~is_gate, value).alias("value"))
    of_key = lambda k, c: F.when(F.col("key") == k, F.col(c))
    joined = parts.groupBy("file", F.col("gate").alias("line")).agg(F.collect_list("head").alias("heads"), *(F.max_by(of_key(k, "value"), of_key(k, "line")).alias(k) for k in ATTRIBUTES))
    joined = joined.withColumn("head", F.explode("heads"))  # one, unless a file stands twice
    title = trimmed(F.regexp_extract("head", GATE, 2))
    name = F.regexp_extract("whole_title", r"^(\S+?):(?:\s+|\z)", 1)
    named = joined.withColumn("whole_title", title).withColumn("name", name)
    unnamed = F.col("name") == ""
    found = named.select(
        "file",
        "line",
        (F.lower(F.regexp_extract("head", GATE, 1)) == "x").alias("checked"),
        unnamed.alias("unnamed"),
        F.when(unnamed, F.concat(F.lit("L"), F.col("line").cast("string"))).otherwise(F.col("name")).alias("id"),
        F.when(unnamed, F.col("whole_title")).otherwise(trimmed(F.regexp_replace("whole_title", r"^(\S+?):(?:\s+|\z)", ""))).alias("title"),
        *ATTRIBUTES,
    )
    said = lines.filter("kind = 'abandon'").select("file", "line", F.regexp_replace(F.regexp_extract("text", ABANDON, 1), r":\z", "").alias("id"), trimmed(F.regexp_extract("text", ABANDON, 2)).alias("reason"))
    turn = F.row_number().over(Window.partitionBy("file", "id").orderBy("line"))
    sound = said.filter("id <> '' and reason <> ''").withColumn("turn", turn)
    abandons = sound.filter("turn = 1").select("file", "line", "id", "reason")
    gates = checkpointed(found.join(abandons.select("file", "id", "reason"), ["file", "id"], "left")).withColumn("deps_given", F.col("deps").isNotNull()).withColumn("declared", listed("deps"))
    heads = gates.select("file", "line", "id")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    expects = F.when(has("expect"), expectation(F.col("expect")))
    paths = F.when(F.col("deps_given"), F.transform(F.filter("declared", lambda p: path_problem(p, True).isNull()), normalized))
    owns_line = lines.filter("kind = 'owns'").withColumn("paths", listed(F.regexp_extract("text", OWNS, 1)))
    early = owns_line.filter("not seen_gate")
    claims = early.select("file", "line", F.explode("paths").alias("given"))
    owns = claims.filter(path_problem(F.col("given")).isNull()).select("file", "line", normalized(F.col("given")).alias("path"))

    def problem(df: DataFrame, rule, subject="id", level: str = "error", line="line") -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.col(x) if x is not None else F.lit(None)
        return df.select("file", as_column(line).cast("long").alias("line"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), F.lit(level).alias("level"), as_column(subject).cast("string").alias("subject"))

    def of_each(df: DataFrame, *rules: tuple) -> DataFrame:
        """The problems of each row by rules (condition, rule, subject, level), in one pass."""
        told = [F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), subject.cast("string").alias("subject"))) for test, rule, subject, level in rules]
        return df.select("file", "line", F.explode(F.array_compact(F.array(*told))).alias("p")).select("file", F.col("line").cast("long").alias("line"), "p.*")

    first = Window.partitionBy("file", "id").orderBy("line")
    again = heads.withColumn("turn", F.row_number().over(first)).withColumn("first_line", F.min("line").over(first)).filter("turn > 1")
    repeated = owned.withColumn("turn", F.row_number().over(Window.partitionBy("file", "gate", "key").orderBy("line"))).filter("turn > 1")
    deps = owned.filter("key = 'deps'").withColumn("paths", listed("value"))
    dep = deps.select("file", "line", F.explode("paths").alias("given")).withColumn("why", path_problem(F.col("given"), True))
    claim = claims.withColumn("why", path_problem(F.col("given")))
    regexes = gates.withColumn("e", expects).filter("e.kind = 'regex'")
    valid = F.arrow_udf(is_pattern, "boolean")
    kind, error, none = F.col("kind"), "error", F.lit(None)
    problems = [
        of_each(
            gates,
            (F.col("unnamed"), "gate-without-id", F.col("id"), error),
            (~F.col("unnamed") & ~F.col("id").rlike(GATE_ID), "invalid-id", F.col("id"), error),
            (F.col("title") == "", "blank-title", F.col("id"), error),
            (has("check") != has("expect"), "check-and-expect-belong-together", F.col("id"), error),
            ((F.col("check") == "") | (F.col("expect") == ""), "blank-check-or-expect", F.col("id"), error),
            (F.col("deps_given") & ~has("check"), "deps-on-manual-gate", F.col("id"), error),
        ),
        of_each(
            lines,
            (kind == "indented-abandon", "indented-abandon", text, error),
            (kind == "unindented", "unindented-attribute", F.lower(F.regexp_extract("text", UNINDENTED, 1)), error),
            ((kind == "attribute") & (F.col("gate") == 0), "orphan-attribute", key, error),
            ((kind == "owns") & F.col("seen_gate"), "owns-after-gate", none, error),
        ),
        of_each(said, (F.col("id") == "", "abandon-without-id", none, error), ((F.col("id") != "") & (F.col("reason") == ""), "abandon-without-reason", F.col("id"), error)),
        problem(again, "duplicate-id", F.concat_ws(":", "id", "first_line")),
        problem(repeated, "duplicate-attribute", "key"),
        problem(deps.filter(F.size("paths") == 0), "deps-empty", None),
        problem(dep.filter("why is not null"), F.concat(F.lit("deps-"), F.col("why")), "given"),
        problem(sound.filter("turn > 1"), "duplicate-abandon"),
        problem(early.filter(F.size("paths") == 0), "owns-empty", None),
        problem(claim.filter("why is not null"), F.concat(F.lit("owns-"), F.col("why")), "given"),
        problem(lines.filter("kind = 'file' and open"), "unclosed-fence", None, line=None),
        problem(regexes.filter("e.too_long"), "expect-too-long"),
        problem(regexes.filter(~F.col("e.too_long") & ~valid("e.value")), "expect-invalid"),
        problem(regexes.filter("e.path_like and not e.too_long"), "path-read-as-regex", level="warning"),
        problem(abandons.join(heads.select("file", "id"), ["file", "id"], "left_anti"), "unknown-abandon"),
    ]
    if need_gates:
        problems.append(problem(lines.filter("kind = 'file'").select("file").join(heads.select("file"), "file", "left_anti"), "no-gates", None, line=None))
    full = gates.select(
        "file", "line", "id", "title", "checked", "check", "expect", "evidence", "cwd", paths.alias("deps"), expects.alias("expectation"),
        F.col("reason").isNotNull().alias("abandoned"), "reason",
        gate_state(F.col("reason").isNotNull(), F.col("checked"), F.col("evidence")).alias("state"), has("check").alias("runnable"),
    )
    return Ledger(full, abandons, owns, together(*problems))
