"""Checks over tables: rows, columns, blanks, duplicates, exact totals, two-source reconciliation
(P1-P5, A1-A6, J1, U2, W5, W7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.config import UsageError, whole
from assay.functions.numbers import exponent_bin, mantissa, parse_number, rounded
from assay.functions.text import is_blank, trimmed

TOLERANCE = 0.001


@dataclass(frozen=True)
class RowBounds:
    """Least and most rows, or an exact number; not both."""

    least: int | None = None
    most: int | None = None
    exact: int | None = None

    def __post_init__(self):
        for name in ("least", "most", "exact"):
            if getattr(self, name) is not None:
                whole(name, getattr(self, name))
        if self.exact is not None and (self.least is not None or self.most is not None):
            raise UsageError("exact excludes least and most")
        if self.least is not None and self.most is not None and self.least > self.most:
            raise UsageError("least is above most")

    def holds(self, n: Column) -> Column:
        tests = [n == self.exact if self.exact is not None else F.lit(True)]
        tests += [n >= self.least] if self.least is not None else []
        tests += [n <= self.most] if self.most is not None else []
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def resolve_column(names: list[str], ref: str) -> int:
    """Index of a column by exact trimmed name, else by 1-based position."""
    found = [i for i, n in enumerate(names) if n == ref.strip()]
    if len(found) > 1:
        raise UsageError(f"column {ref!r} is ambiguous")
    if found:
        return found[0]
    if ref.strip().isdigit() and 1 <= int(ref) <= len(names):
        return int(ref) - 1
    raise UsageError(f"no column {ref!r}")


def row_count(df: DataFrame, target: str, bounds: RowBounds) -> DataFrame:
    n = F.count(F.lit(1)).alias("n_rows")
    return df.agg(n).select(F.lit(target).alias("target"), "n_rows", bounds.holds(F.col("n_rows")).alias("ok"))


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column that the table lacks."""
    spark = df.sparkSession
    want = spark.createDataFrame([(i, c) for i, c in enumerate(required)], "place int, column_name string")
    have = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return want.join(have, "column_name", "left_anti").select("column_name")


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank or missing cells per column, all columns in one pass."""
    counts = df.agg(*(F.count_if(is_blank(F.col(c).cast("string"))).alias(c) for c in columns), F.count(F.lit(1)).alias("__rows"))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_blank")) for c in columns))).alias("cell")
    return counts.select(cells, F.col("__rows").alias("n_rows")).select("cell.column_name", "cell.n_blank", "n_rows")


def duplicate_groups(df: DataFrame, key: Column, row_no: Column) -> DataFrame:
    """Values that occur more than once, trimmed; blank is a value; with count and first row."""
    return df.select(trimmed(F.coalesce(key.cast("string"), F.lit(""))).alias("value"), row_no.cast("long").alias("row_no")).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row")).filter("n > 1")


def listed_rows(df: DataFrame, key: Column, row_no: Column, limit: int = 20) -> DataFrame:
    """Duplicate groups with their first rows listed in order and the number left out.

    Only the first ``limit`` rows of a value reach its list, whatever its size: rows are numbered
    within the group by a window that Spark limits before the sort is complete.
    """
    value = trimmed(F.coalesce(key.cast("string"), F.lit("")))
    rows = df.select(value.alias("value"), row_no.cast("long").alias("row_no"))
    totals = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("value").orderBy("row_no"))).filter(F.col("place") <= limit)
    lists = first.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_no")), lambda r: r.cast("string")), ",").alias("rows"))
    return totals.join(lists, "value").select("value", "n", "rows", F.greatest(F.lit(0).cast("long"), F.col("n") - limit).alias("more"))


def exact_sums(df: DataFrame, value: Column, by: list[str] = (), counts: dict[str, Column] | None = None, name: str = "total") -> DataFrame:
    """Sums of doubles that no order of rows changes: the exact sum, rounded once (A1). Further columns count where a
    condition holds.

    Each number is a whole number of a power of two. These are summed as whole numbers by bins of exponents, in each task
    first; a group has at most some 270 bins, which are put together in its last row. Nulls add nothing; infinities and
    NaN make the sum what they make of any sum. No rows sum to 0.
    """
    by, counts = list(by), counts or {}
    x = value.cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)  # NaN is above all
    rows = df.select(*by, x.alias("__x"), finite.alias("__finite"), exponent_bin(finite).alias("__bin"), *(c.alias(n) for n, c in counts.items()))
    bins = rows.groupBy(*by, "__bin").agg(
        F.sum(mantissa(F.col("__finite"), F.col("__bin")).cast("decimal(20,0)")).alias("__m"),
        F.sum(F.when(F.col("__finite").isNull(), F.col("__x"))).alias("__other"),
        *(F.count_if(n).alias(n) for n in counts),
    )
    parts = F.collect_list(F.when(F.col("__bin").isNotNull(), F.struct(F.col("__bin").alias("bin"), F.col("__m").alias("m"))))
    sums = bins.groupBy(*by).agg(parts.alias("__parts"), F.sum("__other").alias("__other"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts))
    return sums.select(*by, F.coalesce("__other", rounded("__parts")).alias(name), *counts)


def total(df: DataFrame, column: Column, empty_as_zero: bool = False, by: list[str] = ()) -> DataFrame:
    """Exact total of accounting text or numbers, with counted, blank and unreadable cells (A1-A3)."""
    text = column.cast("string")
    number = parse_number(text)
    blank = is_blank(text)
    value = F.when(blank & F.lit(empty_as_zero), F.lit(0.0)).otherwise(number)
    counts = {"counted": value.isNotNull(), "blanks": blank, "not_numbers": ~blank & number.isNull(), "n_rows": F.lit(True)}
    return exact_sums(df, value, by, counts)


def within(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal up to an inclusive tolerance; never for missing values."""
    return F.coalesce(F.abs(a - b) <= F.lit(float(tolerance)), F.lit(False))


def measure(df: DataFrame, amount: Column) -> DataFrame:
    return exact_sums(df, amount, counts={"n_rows": F.lit(True)})


def reconcile(left: DataFrame, right: DataFrame, left_amount: Column, right_amount: Column, tolerance: float = TOLERANCE, rows: bool = True) -> DataFrame:
    """Two independently measured sources: each is reduced to one row first, then compared."""
    a = measure(left, left_amount).withColumnsRenamed({"total": "left_total", "n_rows": "left_rows"})
    b = measure(right, right_amount).withColumnsRenamed({"total": "right_total", "n_rows": "right_rows"})
    both = a.join(F.broadcast(b))  # one row each: both sides are global aggregates
    sums = within(F.col("left_total"), F.col("right_total"), tolerance)
    same = (F.col("left_rows") == F.col("right_rows")) if rows else F.lit(True)
    return both.select(
        "left_total",
        "right_total",
        "left_rows",
        "right_rows",
        sums.alias("sums_agree"),
        same.alias("rows_agree"),
        F.when(sums & same, "pass").otherwise("fail").alias("status"),
    )


def unreadable_cells(df: DataFrame, column: Column, row_no: Column, limit: int = 20) -> DataFrame:
    """Per kind of bad cell, blank or not a number: how many, the first row numbers in order and how many more."""
    text = column.cast("string")
    kind = F.when(is_blank(text), "blank").when(parse_number(text).isNull(), "not-a-number")
    bad = df.select(kind.alias("kind"), row_no.cast("long").alias("row_no")).filter("kind is not null")
    first = bad.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("row_no"))).filter(F.col("place") <= limit)
    lists = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_no")), lambda r: r.cast("string")), ",").alias("rows"))
    return bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(lists, "kind").select("kind", "n", "rows", F.greatest(F.lit(0).cast("long"), F.col("n") - limit).alias("more"))


def first_of_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__place = 1").drop("__place")
