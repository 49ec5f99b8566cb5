"""Workbook checks over cells (sheet, ref, type, value): lookup, equality, depth, errors
(P14-P21, A11, A12, J2, J3, J12, U3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.numbers import numerically_equal, parse_number
from assay.functions.text import cell_row, is_blank, trimmed
from assay.operators.documents import first_placeholder
from assay.operators.tabular import RowBounds


def find_sheets(wanted: DataFrame, sheets: DataFrame) -> DataFrame:
    """wanted(name) to sheets(sheet): exact trimmed name first, else without case; null if absent."""
    w, s = trimmed(F.col("name")), trimmed(F.col("sheet"))
    both = wanted.join(sheets, F.lower(w) == F.lower(s), "left")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.when(w == s, 0).otherwise(1), "sheet"))
    return both.withColumn("place", rank).filter("place = 1").select("name", "sheet", F.when(F.col("sheet").isNull(), "missing").when(w == s, "exact").otherwise("case").alias("route"))


def cells_equal(actual: Column, expected: Column) -> Column:
    """Equal as text or as numbers; blank never."""
    a, e = parse_number(actual), parse_number(expected)
    return F.coalesce(~is_blank(actual) & ((trimmed(actual) == trimmed(expected)) | F.coalesce(numerically_equal(a, e), F.lit(False))), F.lit(False))


def cell_equality(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(sheet, ref, want) against the cells; a missing cell fails."""
    return expected.join(cells.select("sheet", "ref", "value"), ["sheet", "ref"], "left").select("sheet", "ref", "want", "value", cells_equal(F.col("value"), F.col("want")).alias("ok"))


def depths(cells: DataFrame) -> DataFrame:
    """Highest row with content per sheet."""
    return cells.filter(~is_blank(F.col("value"))).groupBy("sheet").agg(F.max(cell_row(F.col("ref"))).cast("long").alias("depth"))


def scan_cells(cells: DataFrame, sheets: list[str] | None = None) -> DataFrame:
    """Cells, filled cells, rows with data, error cells and placeholders per sheet."""
    some = cells if sheets is None else cells.filter(F.col("sheet").isin(sheets))
    filled = ~is_blank(F.col("value"))
    return some.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(filled).alias("filled"),
        F.count_distinct(F.when(filled, cell_row(F.col("ref")))).alias("rows_with_data"),
        F.count_if(F.col("type") == "e").alias("errors"),
        F.count_if(filled & first_placeholder(F.col("value")).isNotNull()).alias("placeholders"),
    )


def shared_strings(cells: DataFrame, strings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cells of type s get their string by index; an index out of range is empty (J2). Strings read from archives are many times
    what Spark takes them for by their entries, so they are merged and never broadcast."""
    shared = strings.select(*by, F.col("idx").cast("string").alias("value"), F.col("text").alias("__text"), F.lit("s").alias("type"))
    both = cells.join(shared.hint("merge"), [*by, "type", "value"], "left")
    return both.select(*[c for c in cells.columns if c != "value"], F.when(F.col("type") == "s", F.coalesce("__text", F.lit(""))).otherwise(F.col("value")).alias("value"))


def sheet_map(sheets: DataFrame, relations: DataFrame, by: list[str] = ()) -> DataFrame:
    """sheets(name, rid) to relations(rid, target): name and target_path; a sheet without relation goes."""
    target = F.when(F.col("target").startswith("/"), F.substr("target", F.lit(2))).when(F.col("target").startswith("xl/"), F.col("target")).otherwise(F.concat(F.lit("xl/"), F.col("target")))
    return sheets.filter("name is not null").join(relations.hint("merge"), [*by, "rid"]).select(*by, "name", F.regexp_replace(target, r"^xl/\.\./", "").alias("target_path"))


def sheet_rules(sheets: DataFrame, required: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Required names that no sheet has, and forbidden names that one has (P14, U2, U3); names compare as in find_sheets."""
    missing = find_sheets(required, sheets).filter("sheet is null").select("name", F.lit("missing").alias("rule"))
    present = find_sheets(forbidden, sheets).filter("sheet is not null").select("name", F.lit("forbidden").alias("rule"))
    return missing.unionByName(present)


def sheet_count(sheets: DataFrame, bounds: RowBounds) -> DataFrame:
    """Number of sheets and whether it is as asked."""
    return sheets.agg(F.count(F.lit(1)).alias("sheets")).select("sheets", bounds.holds(F.col("sheets")).alias("ok"))
