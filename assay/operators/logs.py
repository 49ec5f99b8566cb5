"""Log scans: positive controls, required and forbidden patterns, tail, staged verdict
(P28-P33, A13, X3, S6, W2, W4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.config import UsageError, whole
from assay.functions.patterns import refuse_runaway
from assay.functions.text import is_blank

STAGES = ("empty", "control", "required", "forbidden", "pass")


@dataclass(frozen=True)
class LogScan:
    """What a log must and must not show. Forbidding needs a control that proves the scan can see."""

    forbid: tuple[str, ...] = ()
    require: tuple[str, ...] = ()
    control: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    flags: str = "i"
    least_lines: int = 1
    tail: int | None = None

    def __post_init__(self):
        if self.forbid and not self.control:
            raise UsageError("a forbidden pattern needs a positive control")
        if not (self.forbid or self.require or self.control):
            raise UsageError("nothing is asserted")
        if set(self.flags) - set("imsu") or len(set(self.flags)) < len(self.flags):
            raise UsageError("flags are i, m, s and u, each once")
        whole("least_lines", self.least_lines)
        if self.tail is not None:
            whole("tail", self.tail, 1)

        for source in (*self.forbid, *self.require, *self.control, *self.ignore):
            refuse_runaway(source, self.flags)

    def pattern(self, source: str) -> str:
        flags = self.flags + ("u" if "i" in self.flags and "u" not in self.flags else "")
        return f"(?{flags}){source}" if flags else source


def log_lines(text: Column) -> Column:
    """Array of (number, text) of the lines that are not blank; numbers count blank lines."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line, i: F.struct((i + 1).cast("long").alias("number"), line.alias("text")))
    return F.filter(lines, lambda x: ~is_blank(x["text"]))


def tail(lines: DataFrame, n: int, number: str = "number") -> DataFrame:
    """The last n lines (P32): a top-n per log, not a sort of all."""
    return lines.orderBy(F.desc(number)).limit(n)


def tail_each(lines: DataFrame, log: str | list[str], n: int, number: str = "number") -> DataFrame:
    window = Window.partitionBy(*([log] if isinstance(log, str) else log)).orderBy(F.desc(number))
    return lines.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n).drop("place")


def any_match(text: Column, patterns: tuple[str, ...], scan: LogScan) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(scan.pattern(p))
    return out


def scanned(lines: DataFrame, scan: LogScan, by: list[str], number: str) -> DataFrame:
    """The lines with a column ``scanned``: in the tail that the scan is limited to. The tail's first number is found by
    a top-n (per log a limited window), so no log is sorted as a whole."""
    if scan.tail is None:
        return lines.withColumn("scanned", F.lit(True))
    if number not in lines.columns:
        raise UsageError("a tail needs numbered lines")
    last = (tail_each(lines, by, scan.tail, number) if by else tail(lines, scan.tail, number)).groupBy(*by).agg(F.min(number).alias("__first"))
    both = lines.join(last, by) if by else lines.join(F.broadcast(last))  # one row
    return both.withColumn("scanned", F.col(number) >= F.col("__first")).drop("__first")


def pattern_counts(lines: DataFrame, scan: LogScan, by: list[str] = (), text: str = "text", number: str = "number") -> DataFrame:
    """Lines per role and pattern in one pass; ignored lines count against forbidding alone (A13, P30). All lines
    are counted, the patterns only in the tail if there is one (P31, P32)."""
    by, line = list(by), F.col(text)
    live = ~any_match(line, scan.ignore, scan)
    roles = [(r, p, F.col("scanned") & line.rlike(scan.pattern(p)) & (live if r == "forbid" else F.lit(True))) for r in ("control", "require", "forbid") for p in getattr(scan, r)]
    sums = scanned(lines, scan, by, number).groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), *(F.count_if(test).alias(f"c{i}") for i, (_, _, test) in enumerate(roles)))
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(p).alias("pattern"), F.col(f"c{i}").alias("n")) for i, (r, p, _) in enumerate(roles)))).alias("cell")
    return sums.select(*by, "lines", cells).select(*by, "lines", "cell.*")


def verdict(lines: DataFrame, scan: LogScan, by: list[str] = (), text: str = "text", number: str = "number") -> DataFrame:
    """The first stage that fails, in the order of STAGES; all counts come from one pass."""
    counts = pattern_counts(lines, scan, by, text, number)
    missing = lambda role: F.coalesce(F.max((F.col("role") == role) & (F.col("n") == 0)), F.lit(False))
    summed = counts.groupBy(*by).agg(
        F.coalesce(F.max("lines"), F.lit(0)).alias("lines"),
        missing("control").alias("no_control"),
        missing("require").alias("no_required"),
        F.coalesce(F.sum(F.when(F.col("role") == "forbid", F.col("n"))), F.lit(0)).alias("forbidden_hits"),
    )
    stage = F.when(F.col("lines") < scan.least_lines, "empty").when(F.col("no_control"), "control").when(F.col("no_required"), "required").when(F.col("forbidden_hits") > 0, "forbidden").otherwise("pass")
    return summed.select(*by, "lines", "forbidden_hits", stage.alias("stage"))
