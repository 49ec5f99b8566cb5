"""Text functions: blank tests, cleaning, excerpts, evidence fields, CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The success line's marker, what replaces it, and the characters that no report may print.
PASS_MARKER = "ASSAY-CHECK-OK"
REDACTED = "[redacted-marker]"
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{2028}\x{2029}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]"
NOT_WHITE = r"[^\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WHITE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def is_blank(text: Column) -> Column:
    """Missing, empty or white space alone."""
    return F.coalesce(text, F.lit("")).rlike(rf"^{WHITE}*\z")


def clean(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, " ")


def redact(text: Column) -> Column:
    """Cleaned, and with the success marker taken out so that no failure can forge it."""
    return F.replace(clean(text), F.lit(PASS_MARKER), F.lit(REDACTED))


def diagnostic(text: Column, limit: int = 500) -> Column:
    return F.left(collapsed(clean(text)), F.lit(limit))


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, rf"{WHITE}+", " "))


def excerpt(text: Column, limit: int) -> Column:
    """The head of a longer text, with three dots inside the limit."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def log_excerpt(text: Column, limit: int = 120) -> Column:
    """A log line without outer white space, bounded."""
    return excerpt(trimmed(text), limit)


def cell_excerpt(text: Column, limit: int = 60) -> Column:
    """A cell's collapsed text; of a longer one the whole limit, and dots after it (F8)."""
    flat = collapsed(text)
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def excerpt_around(text: Column, at: Column, before: int = 12, limit: int = 60) -> Column:
    """A view of at most ``limit`` characters from ``before`` characters ahead of 0-based ``at`` on; dots
    stand for what is left out on either side (F6)."""
    tail = F.concat(F.lit("..."), F.substr(text, at - before + 1))
    return excerpt(F.when(at > before, tail).otherwise(text), limit)


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x{feff}\x{fffe}]", "")


def csv_cell(value: Column) -> Column:
    """Quoted if it holds a quote, comma or line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def evidence_fields(raw: Column) -> Column:
    """Map of the ``key=value`` parts; null where evidence is missing or pending; a later key wins."""
    parts = F.filter(F.transform(F.split(raw, ";"), trimmed), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(trimmed(F.regexp_extract(p, r"(?s)^([^=]*)=", 1)).alias("key"), trimmed(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.when(is_blank(raw) | (F.lower(trimmed(raw)) == "pending"), F.lit(None)).otherwise(F.map_from_entries(last))


def is_pending(evidence: Column) -> Column:
    return F.coalesce(evidence, F.lit("")).rlike(r"(?i)^\s*(pending)?\s*\z")


def qualified(file: Column, gate: Column) -> Column:
    """File stem and gate id."""
    return F.concat(F.regexp_extract(file, r"([^/\\]*?)(\.[^./\\]*)?$", 1), F.lit(":"), gate)


def cell_row(ref: Column) -> Column:
    """Row number at the end of a cell reference (F16), all its digits; null if there is none."""
    return F.regexp_extract(ref, r"([0-9]+)\z", 1).try_cast("bigint")


def expectation(expect: Column) -> Column:
    """What an expectation means: text, or a pattern between slashes with flags; ``path_like`` marks an
    inner slash that is not escaped (F17)."""
    is_pattern = expect.rlike(r"(?s)^/.*/[a-z]*\z")
    source = F.when(is_pattern, F.regexp_extract(expect, r"(?s)^/(.*)/[a-z]*\z", 1))
    return F.struct(
        F.when(is_pattern, F.lit("regex")).otherwise(F.lit("text")).alias("kind"),
        F.coalesce(source, expect).alias("value"),
        F.when(is_pattern, F.regexp_extract(expect, r"/([a-z]*)\z", 1)).alias("flags"),
        F.coalesce(source.rlike(r"(^|[^\\])/"), F.lit(False)).alias("path_like"),
        F.coalesce(F.length(source) > 1000, F.lit(False)).alias("too_long"),
    )


def is_name(text: Column) -> Column:
    """A scope or leaf id."""
    return text.rlike(NAME) & ~text.isin(".", "..")


def is_handle(text: Column) -> Column:
    return (F.length(text) <= 256) & ~is_blank(text) & ~text.rlike(CONTROL)


def is_reason(text: Column) -> Column:
    return (F.length(text) <= 500) & ~is_blank(text) & ~text.rlike(CONTROL)


def is_time(text: Column) -> Column:
    """A readable ISO time."""
    return F.coalesce(text, F.lit("")).rlike(r"^\d{4}-\d\d-\d\d") & F.try_to_timestamp(text).isNotNull()


def last_lines(text: Column, limit: int = 240) -> Column:
    """The last two lines with content, joined; a fixed phrase where there is none."""
    lines = full_lines(text)
    some = F.when(F.size(lines) > 2, F.slice(lines, -2, 2)).otherwise(lines)
    return F.left(F.coalesce(F.nullif(F.array_join(some, " | "), F.lit("")), F.lit("(no output)")), F.lit(limit))


def full_lines(text: Column) -> Column:
    """The trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: x != "")


def failure_summary(text: Column, head: int = 6, last: int = 2, limit: int = 480) -> Column:
    """All lines of a short output; of a longer one the first six, dots and the last two."""
    lines = full_lines(text)
    parts = F.when(F.size(lines) <= head + last, lines).otherwise(F.concat(F.slice(lines, 1, head), F.array(F.lit("...")), F.slice(lines, -last, last)))
    return F.left(F.coalesce(F.nullif(F.array_join(parts, " | "), F.lit("")), F.lit("(no output)")), F.lit(limit))


def distinct_in_order(items: Column) -> Column:
    """Each item where it comes first (U4)."""
    return F.filter(items, lambda x, i: F.array_position(items, x) == i + 1)
