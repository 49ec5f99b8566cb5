"""Ledger semantics: gate states, verdicts, diagnostics, lint, stale results
(D15, A14-A17, A23, J6, J7, J13, J15, L2-L8, P34-P38, 2.9.3, 2.9.4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.patterns import refuse_runaway
from assay.functions.text import expectation, is_pending, trimmed

# Expectations too weak to tell success, commands whose output never changes, first words of
# titles that say what is done and not what comes of it.
WEAK_EXPECT = ("ok", "okay", "done", "pass", "passed", "success", "successful", "succeeded", "complete", "completed", "finished", "yes", "true", "0", "good", "fine", "working")
FIXED_OUTPUT = r"(?i)^\s*((echo|printf)(\s+[^&|;]*)?|true|:|exit\s+0)\s*$"
ACTIVITY = r"(?i)^(work(ing)? on|improve|enhance|handle|support|ensure|make sure|try|attempt|look (at|into)|investigate|consider|review|refactor|clean ?up|polish|update|tidy|address|deal with|add support)\b"


def gate_state(abandoned: Column, checked: Column, evidence: Column) -> Column:
    """Abandoned before unchecked before checked without evidence before met."""
    return F.when(abandoned, "abandoned").when(~checked, "unmet").when(is_pending(evidence), "unmet-no-evidence").otherwise("met")


def state_counts(gates: DataFrame, by: list[str]) -> DataFrame:
    """gates(state, runnable) counted by state and kind."""
    is_state = lambda s: F.count_if(F.col("state") == s)
    return gates.groupBy(*by).agg(
        is_state("met").alias("met"),
        is_state("unmet").alias("unmet"),
        is_state("unmet-no-evidence").alias("unmet_no_evidence"),
        is_state("abandoned").alias("abandoned"),
        F.count_if("runnable").alias("runnable"),
        F.count_if(~F.col("runnable")).alias("manual"),
    )


def verdict(counts: DataFrame, extra: Column = None, blockers: Column = None) -> DataFrame:
    """all-met, handoff-required or unmet; an abandoned gate always blocks and its label wins."""
    extra, blockers = F.lit(0) if extra is None else extra, F.lit(0) if blockers is None else blockers
    unmet = F.col("unmet") + F.col("unmet_no_evidence") + extra + blockers
    label = F.when((unmet == 0) & (F.col("abandoned") == 0), "all-met").when(F.col("abandoned") > 0, "handoff-required").otherwise("unmet")
    return counts.withColumns({"effective_unmet": unmet.cast("long"), "reported_met": F.greatest(F.lit(0), F.col("met") - extra).cast("long"), "verdict": label})


def duplicate_ids(gates: DataFrame) -> DataFrame:
    """Gate ids declared twice in a file, with the first line."""
    return gates.groupBy("file", "id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")).filter("n > 1")


def unknown_abandons(abandons: DataFrame, gates: DataFrame) -> DataFrame:
    """Abandoned ids that the file does not declare."""
    return abandons.join(gates.select("file", "id"), ["file", "id"], "left_anti")


def incomplete_checks(gates: DataFrame) -> DataFrame:
    """A check without an expectation, or the reverse."""
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rule = F.when(has("check") & ~has("expect"), "check-without-expect").when(~has("check") & has("expect"), "expect-without-check")
    return gates.withColumn("rule", rule).filter("rule is not null")


def lint(gates: DataFrame) -> DataFrame:
    """Warnings per live gate (file, id, rule): one pass, rules are columns."""
    manual = F.coalesce(F.col("check"), F.lit("")) == ""
    weak = F.lower(trimmed(F.coalesce("expect", F.lit("")))).isin(*WEAK_EXPECT)
    rules = F.filter(
        F.array(
            F.when(F.coalesce(F.col("check").rlike(FIXED_OUTPUT), F.lit(False)), "tautological-check"),
            F.when(F.col("expect").isNotNull() & weak, "weak-expect"),
            F.when(F.coalesce(expectation(F.col("expect"))["path_like"], F.lit(False)), "path-read-as-regex"),
            F.when(manual, "manual-gate"),
            F.when(manual & F.col("title").rlike("[0-9]"), "unmeasured-number"),
            F.when(F.col("title").rlike(ACTIVITY), "activity-not-outcome"),
        ),
        lambda r: r.isNotNull(),
    )
    return gates.filter(~F.col("abandoned")).select("file", "id", F.explode(rules).alias("rule"))


def mostly_manual(gates: DataFrame) -> DataFrame:
    """Runnable share of live gates per file, and whether it is below a half."""
    return gates.filter(~F.col("abandoned")).groupBy("file").agg(F.count(F.lit(1)).alias("live"), F.count_if(F.coalesce(F.col("check"), F.lit("")) != "").alias("runnable")).withColumn("mostly_manual", F.col("runnable") * 2 < F.col("live"))


def apply_results(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Results(file, id, signature, ok) written back to the fresh ledger: a changed or missing gate is stale (J6). One row
    for each result, also where the ledger has an id twice."""
    fresh = ledger.select("file", "id", "signature").distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("known").isNull(), "stale").when(F.col("ok"), "met").otherwise("unmet")
    return results.join(fresh, ["file", "id", "signature"], "left").select("file", "id", "ok", state.alias("outcome"))


def passed(exit_code: Column, matched: Column, error: Column) -> Column:
    """No error, exit code zero and the expectation matched."""
    return error.isNull() & (exit_code == 0) & F.coalesce(matched, F.lit(False))


def matches(output: Column, expect: str) -> Column:
    """A plain expectation is a substring; one between slashes a pattern (P34), which must not be able to run away."""
    import re

    from assay.config import UsageError

    found = re.fullmatch(r"/(.*)/([a-z]*)", expect, re.S)
    if not found:
        return output.contains(expect)
    if len(found[1]) > 1000:
        raise UsageError("the pattern is longer than 1000 characters")
    flags = "".join(sorted(set(found[2]) & set("ims")))
    refuse_runaway(found[1], flags)
    return output.rlike(f"(?{flags}{'u' if 'i' in flags else ''}){found[1]}" if flags else found[1])


def select_gates(gates: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(name): a bare or qualified id; anything but one match is reported as such."""
    named = gates.select("file", "id", F.explode(F.array("id", F.concat_ws(":", "file", "id"))).alias("name"))
    found = wanted.join(named, "name", "left").groupBy("name").agg(F.count("id").alias("n"), F.min("file").alias("file"), F.min("id").alias("id"))
    return found.select("name", F.when(F.col("n") == 1, F.col("file")).alias("file"), F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, "selected").when(F.col("n") == 0, "unknown").otherwise("ambiguous").alias("state"))


def pending(gates: DataFrame, reverify: bool = False) -> DataFrame:
    """Gates that a run is about: runnable and not abandoned; met ones only to verify them again."""
    live = gates.filter(F.col("runnable") & (F.col("state") != "abandoned"))
    return live if reverify else live.filter("state <> 'met'")


def unreadable_deps(gates: DataFrame, digests: DataFrame) -> DataFrame:
    """file, id, path of the named files without a digest; any blocks its run (P38). gates has deps, digests(path, sha256)."""
    named = gates.select("file", "id", F.explode("deps").alias("path"))
    return named.join(digests.filter("sha256 is not null"), "path", "left_anti").select("file", "id", "path")


def reverified(gates: DataFrame, results: DataFrame) -> DataFrame:
    """Gates after all runnable ones ran again (2.9.4, J15): one that fails is unchecked and pending; one that was met and
    did not run, or ran against another text of itself alone, counts as unmet. results(file, id, signature, ok). One row for
    each gate, also where an id stands twice; of several results of one text, one that fails counts."""
    ran = results.groupBy("file", "id", "signature").agg(F.bool_and("ok").alias("ok"))
    both = gates.join(ran, ["file", "id", "signature"], "left")
    ok = F.col("runnable") & F.col("ok")
    extra = F.col("runnable") & (F.col("state") == "met") & F.col("ok").isNull()
    state = F.when(F.col("runnable") & ~F.col("ok") & F.col("state").isin("met", "unmet-no-evidence"), "unmet").when(ok & (F.col("state") != "abandoned"), "met").otherwise(F.col("state"))
    return both.select("file", "id", state.alias("state"), extra.alias("extra_unmet"))
