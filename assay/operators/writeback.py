"""Results written back into ledgers, and approvals over the bytes of dependencies.

A ledger is never changed in place: the result is a table of new texts. Lines that change are rows of their own; they meet
their ledger's other lines by file and number, and each ledger is put together again in order with its own line end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.config import checkpointed
from assay.functions.text import is_pending
from assay.sources.ledgers import Ledger, told

# The box of a gate's line, and the lines that stand between a gate and new evidence.
BOX = r"^- \[( |x|X)\]"
BELOW = r"^\s+(CHECK|EXPECT|EVIDENCE|CWD):"
KEY = ["file", "id"]


class Written(NamedTuple):
    """texts(file, text) of the ledgers that change; outcomes(file, id, outcome), one row for each result's gate: met, unmet,
    unchanged (it failed and was not met), stale (its text has changed or it is gone) or invalid (its ledger has errors)."""

    texts: DataFrame
    outcomes: DataFrame


def dep_digests(contents: DataFrame) -> DataFrame:
    """path, sha256 of contents(path, content): bytes, not text. Unreadable content (null) has no digest."""
    return contents.select("path", F.sha2("content", 256).alias("sha256"))


def signed_gates(gates: DataFrame, digests: DataFrame, **settings: str) -> DataFrame:
    """Gates with signature and blocked.

    gates(file, id, check, expect, cwd, deps); digests(path, sha256). The signature is over what a run depends on: check,
    expectation, folder, the given settings, and each dependency with its digest in the order of the gate. A gate without
    deps signs none. One whose dependency has no digest is blocked. Repeated rows of a gate stay; of several digests of one
    path the least counts.
    """
    named = gates.select("deps").distinct().select("deps", F.posexplode("deps").alias("at", "path"))
    known = digests.groupBy("path").agg(F.min("sha256").alias("sha256"))
    read = named.join(known, "path", "left").groupBy("deps").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "path", "sha256"))), lambda d: F.struct(d["path"].alias("path"), d["sha256"].alias("sha256"))).alias("read"),
        F.bool_or(F.col("sha256").isNull()).alias("blocked"),
    )
    oracle = F.to_json(F.struct("check", "expect", "cwd", F.col("read").alias("deps"), *(F.lit(v).alias(k) for k, v in sorted(settings.items()))))
    # gates without deps have no partner: as keys without a value they would all meet in one task
    bare = F.coalesce(F.size("deps") <= 0, F.lit(True))
    some = gates.filter(~bare).join(read, "deps", "left")
    alone = gates.filter(bare).withColumns({"read": F.lit(None).cast(read.schema["read"].dataType), "blocked": F.lit(False)})
    return some.unionByName(alone).withColumn("signature", F.sha2(oracle, 256)).withColumn("blocked", F.coalesce("blocked", F.lit(False))).drop("read")


def approval_states(signed: DataFrame, approvals: DataFrame) -> DataFrame:
    """signed gates with approval: blocked, approved (one of their own signature stands) or refused."""
    given = approvals.select("file", "id", "signature").distinct().withColumn("given", F.lit(True))
    state = F.when(F.col("blocked"), "blocked").when(F.col("given"), "approved").otherwise("refused")
    return signed.join(given, [*KEY, "signature"], "left").withColumn("approval", state).drop("given")


def outcomes(results: DataFrame, signed: DataFrame, broken: DataFrame) -> DataFrame:
    """file, id, line, outcome, evidence of each gate that results(file, id, signature, ok, was_met, evidence) tell of.

    Of several results of a gate one that fails counts, and one of another signature makes it stale.
    """
    told_of = results.groupBy(*KEY).agg(F.bool_and("ok").alias("ok"), F.bool_or("was_met").alias("was_met"), F.max("evidence").alias("evidence"), F.min("signature").alias("lo"), F.max("signature").alias("hi"))
    first = signed.groupBy(*KEY).agg(F.min_by("signature", "line").alias("now"), F.min("line").alias("line"))
    both = told_of.join(first, KEY, "left").join(broken.select("file", F.lit(True).alias("broken")).distinct(), "file", "left")
    same = (F.col("lo") == F.col("now")) & (F.col("hi") == F.col("now"))
    outcome = F.when(F.col("broken"), "invalid").when(F.coalesce(same, F.lit(False)), F.when(F.col("ok"), "met").when(F.col("was_met"), "unmet").otherwise("unchanged")).otherwise("stale")
    return both.select(*KEY, "line", outcome.alias("outcome"), F.when(F.col("ok"), F.col("evidence")).otherwise("pending").alias("evidence"))


def patched(files: DataFrame, changes: DataFrame) -> DataFrame:
    """file, text of the ledgers of files(file, text) that changes(file, line, outcome, evidence) tell of.

    The box of a gate's line is set; its last evidence line is replaced and keeps its indent, or one is put behind the gate's
    attribute lines. Text with any CRLF is joined by CRLF, other text by LF; a last line end stays.
    """
    touched = checkpointed(files.join(changes.select("file").distinct(), "file", "left_semi"))
    lines = touched.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "text")).select("file", (F.col("at") + 1).cast("long").alias("line"), "text")
    evidence = told(touched).filter("kind = 'attribute' and gate > 0").filter(F.col("text").rlike(r"^\s+EVIDENCE:")).groupBy("file", F.col("gate").alias("line")).agg(F.max("line").alias("evidence_line"))
    # a gate's line and the attribute lines under it are one run
    run = F.count_if(~F.col("text").rlike(BELOW)).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = lines.withColumn("run", run).groupBy("file", "run").agg(F.min("line").alias("line"), F.max("line").alias("last"))
    placed = changes.join(evidence, ["file", "line"], "left").join(runs.select("file", "line", "last"), ["file", "line"])
    patches = placed.select(
        "file",
        F.explode(
            F.array(
                F.struct("line", F.when(F.col("outcome") == "met", "- [x]").otherwise("- [ ]").alias("box"), F.lit(None).cast("string").alias("new"), F.lit(None).cast("string").alias("more")),
                F.struct(F.coalesce("evidence_line", "last").alias("line"), F.lit(None).cast("string").alias("box"), F.when(F.col("evidence_line").isNotNull(), F.col("evidence")).alias("new"), F.when(F.col("evidence_line").isNull(), F.col("evidence")).alias("more")),
            )
        ).alias("p"),
    )
    of_line = patches.groupBy("file", "p.line").agg(*(F.max(f"p.{c}").alias(c) for c in ("box", "new", "more")))
    boxed = F.when(F.col("box").isNotNull(), F.regexp_replace(F.col("text"), F.lit(BOX), F.col("box"))).otherwise(F.col("text"))
    text = F.when(F.col("new").isNotNull(), F.concat(F.regexp_extract("text", r"^\s*", 0), F.lit("EVIDENCE: "), F.col("new"))).otherwise(boxed)
    changed = lines.join(of_line, ["file", "line"], "left").select("file", F.struct("line", text.alias("text"), F.concat(F.lit("  EVIDENCE: "), F.col("more")).alias("more")).alias("l"))
    ordered = changed.groupBy("file").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    joined = lambda end: F.array_join(F.flatten(F.transform("ls", lambda l: F.filter(F.array(l["text"], l["more"]), lambda x: x.isNotNull()))), end)  # noqa: E731, E741
    ends = touched.select("file", F.col("text").contains("\r\n").alias("crlf"))
    return ordered.join(ends, "file").select("file", F.when(F.col("crlf"), joined("\r\n")).otherwise(joined("\n")).alias("text"))


def write_back(files: DataFrame, fresh: Ledger, results: DataFrame, digests: DataFrame, **settings: str) -> Written:
    """New texts of the ledgers of files(file, text), which fresh was parsed from, after results.

    A result whose gate has another signature now changes nothing, nor does any in a ledger with errors. Null texts have no
    gates. No results give no texts. The outcomes, a row for each result's gate, are written once and read by all that follows.
    """
    signed = signed_gates(fresh.gates, digests, **settings)
    found = checkpointed(outcomes(results, signed, fresh.problems.filter("level = 'error'")))
    return Written(patched(files, found.filter("outcome in ('met', 'unmet')")), found.select(*KEY, "outcome"))


def met_before(gates: DataFrame) -> DataFrame:
    """Gates with was_met: checked, not abandoned and with evidence."""
    return gates.withColumn("was_met", F.col("checked") & ~F.col("abandoned") & ~is_pending(F.col("evidence")))
