"""Number functions: accounting text, exact parts of doubles, tolerant equality, ages."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.text import WHITE

MONEY = "decimal(38,6)"
# Signs that may stand anywhere in a number.
SIGNS = "[%₩$]"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once. Written plainly, a value that branches name several times is made again for each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_number(text: Column) -> Column:
    """The double nearest to the number that accounting text shows, or null; a number beyond all doubles is none.

    White space and commas go; brackets around all negate; one leading sign counts; % and currency
    signs go; then digits with at most one point, and a digit after it, must be left.
    """
    bare = F.regexp_replace(text, rf"{WHITE}|,", "")
    bracketed = lambda b: b.rlike(r"^\(.*\)\z")
    parts = lambda b: F.struct(bracketed(b).alias("bracketed"), F.when(bracketed(b), F.regexp_extract(b, r"^\((.*)\)\z", 1)).otherwise(b).alias("inner"))
    digits = lambda p: F.regexp_replace(F.regexp_replace(p["inner"], r"^[+-]", ""), SIGNS, "")
    value = lambda d: F.when(d.rlike(r"^\d*\.?\d+\z"), d).try_cast("double")
    signed = lambda p: once(once(digits(p), value), lambda v: F.when(v < float("inf"), F.when(p["bracketed"] != p["inner"].startswith("-"), -v).otherwise(v)))
    return once(once(bare, parts), signed)


#: Doubles are summed by bins of so many exponents.
BIN = 8


def exponent_bin(x: Column) -> Column:
    """The lowest exponent of the bin that a finite double belongs to; null for zero. The logarithm may be off by one in
    its last place, so the bin starts one exponent lower than it says."""
    return (F.floor((F.floor(F.log2(F.abs(x))) - 1) / BIN) * BIN).cast("int")


def mantissa(x: Column, bin: Column) -> Column:
    """``x`` as a whole number of 2^(bin - 52): exact, and below 2^62. Two steps keep the powers of two within doubles."""
    shift = 52 - bin
    half = (shift / 2).cast("int")
    return (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half)).cast("long")


def rounded(parts: Column) -> Column:
    """The double nearest to a sum of mantissas by bins, array of (bin, m), ties to even: the one rounding of a whole sum."""
    low = 1200  # below all bins, so that shifts are to the left

    def put(sums: pa.Array) -> pa.Array:
        out = []
        for row in sums.to_pylist():
            exact = sum(int(p["m"]) << p["bin"] + low for p in row)
            try:
                out.append(exact / (1 << low + 52))
            except OverflowError:
                out.append(float("inf") if exact > 0 else float("-inf"))
        return pa.array(out, pa.float64())

    return F.arrow_udf(put, "double")(parts)


def numerically_equal(a: Column, b: Column) -> Column:
    """Equal within a billionth of the larger, or of one."""
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def age_hours(when: Column, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(when)) / F.lit(3_600_000.0)


def shown_number(value: Column, places: int = 6) -> Column:
    """At most six decimals, no trailing zeros and no negative zero."""
    text = F.coalesce(F.round(value.try_cast(MONEY), places).cast("string"), value.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    return F.when(bare == "-0", F.lit("0")).otherwise(bare)


def tolerance(given: str) -> float:
    """A tolerance as accounting text: a number that is not negative."""
    import re

    from assay.config import UsageError

    bare = re.sub(r"[\s,]", "", given)
    if not re.fullmatch(r"\+?[%₩$]*\d*\.?\d+", bare):
        raise UsageError(f"tolerance must be a number of at least 0, not {given!r}")
    return float(re.sub(r"[+%₩$]", "", bare))
