"""Document checks over paragraphs (P21-P27, A8-A10, F5, F6): placeholders, headings, texts, sizes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.config import UsageError, whole
from assay.functions.patterns import literal_core
from assay.functions.text import NOT_WHITE, collapsed, excerpt_around

# What counts as an unfilled place in a document and in a workbook cell. The two lists differ.
DOCUMENT_PLACEHOLDERS = (
    ("TODO marker", r"(?i)(^|[^0-9A-Za-z])TODO([^0-9A-Za-z]|$)"),
    ("TBD marker", r"(?i)(^|[^0-9A-Za-z])TBD([^0-9A-Za-z]|$)"),
    ("FIXME marker", r"(?i)(^|[^0-9A-Za-z])FIXME([^0-9A-Za-z]|$)"),
    ("XXX marker", r"(?i)(^|[^0-9A-Za-z])XXX([^0-9A-Za-z]|$)"),
    ("OOO marker", r"(^|[^0-9A-Za-z])OOO([^0-9A-Za-z]|$)"),
    ("circle marker", r"○○○"),
    ("lorem ipsum filler", r"(?i)lorem\s+ipsum"),
    ("angle bracket placeholder", r"<(?!\/)[^<>]{1,39}>"),
    ("double bracket placeholder", r"\[\[[^\]\[]{0,80}\]\]"),
    ("double brace placeholder", r"\{\{[^{}]{0,80}\}\}"),
    ("Korean placeholder 여기에", r"여기에"),
    ("Korean placeholder 내용을 입력", r"내용을\s*입력"),
    ("Korean placeholder 작성 요망", r"작성\s*요망"),
    ("Korean placeholder 기재 요망", r"기재\s*요망"),
)
CELL_PLACEHOLDERS = (
    ("TODO", r"(?i)(^|[^0-9A-Za-z])TODO([^0-9A-Za-z]|$)"),
    ("TBD", r"(?i)(^|[^0-9A-Za-z])TBD([^0-9A-Za-z]|$)"),
    ("FIXME", r"(?i)(^|[^0-9A-Za-z])FIXME([^0-9A-Za-z]|$)"),
    ("XXX", r"(?i)(^|[^0-9A-Za-z])XXX([^0-9A-Za-z]|$)"),
    ("여기에", r"여기에"),
    ("입력 요망", r"입력\s*요망"),
    ("기재 요망", r"기재\s*요망"),
    ("OOO", r"(?i)(^|[^0-9A-Za-z])OOO"),
    ("○○○", r"○○○"),
)
HEADING = r"(?iu)^(Heading[1-9]|Title|Subtitle|제목\s*[1-9]?|표제)"
SHORT = 80


def is_heading_style(style: Column) -> Column:
    return F.coalesce(style, F.lit("")).rlike(HEADING)


def paragraphs_of(text: Column) -> Column:
    """Array of (idx, text) of the lines of a text, indexes from 1 and with empty ones."""
    return F.transform(F.split(text, "\n"), lambda p, i: F.struct((i + 1).alias("idx"), p.alias("text")))


def may_match(text: Column, lowered: Column, pattern: str) -> Column:
    """False only if the text lacks what every match has; a search for fixed bytes, far cheaper than the pattern."""
    core = literal_core(pattern)
    return F.lit(True) if core is None else (lowered if core[1] else text).contains(core[0])


def placeholder_hits(rows: DataFrame, text: str = "text", keep: list[str] = ("idx",), patterns=DOCUMENT_PLACEHOLDERS) -> DataFrame:
    """Every pattern that a paragraph matches, with its first place; no join, patterns are literals.
    A pattern looks only at paragraphs that hold its fixed part; the text is lowered once for all of them."""
    held = rows.select(*keep, F.col(text).alias("__text"), F.lower(text).alias("__lowered"))
    line, lowered = F.col("__text"), F.col("__lowered")
    place = lambda p: F.when(may_match(line, lowered, p), F.regexp_instr(line, F.lit(p)) - 1)
    hits = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), place(p).alias("at")) for label, p in patterns)), lambda h: h["at"] >= 0)
    return held.select(*keep, "__text", F.explode(hits).alias("hit")).select(*keep, "hit.label", excerpt_around(line, F.col("hit.at")).alias("excerpt"))


def first_placeholder(text: Column, patterns=CELL_PLACEHOLDERS) -> Column:
    """The first pattern in order that a cell matches, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for label, p in patterns:
        out = out.when(may_match(text, F.lower(text), p) & text.rlike(p), F.lit(label))
    return out


def heading_routes(paragraphs: DataFrame, wanted: list[str], by: list[str] = ()) -> DataFrame:
    """Per wanted heading: found by a heading style, else by a short paragraph, else missing."""
    text, style = F.lower(collapsed(F.col("text"))), is_heading_style(F.col("style"))
    short = (F.length(text) < SHORT) & (text != "")
    sums = paragraphs.groupBy(*by).agg(*(F.struct(F.coalesce(F.max(style & text.contains(w.lower())), F.lit(False)).alias("styled"), F.coalesce(F.max(short & text.contains(w.lower())), F.lit(False)).alias("short")).alias(f"w{i}") for i, w in enumerate(wanted)))
    cells = F.explode(F.array(*(F.struct(F.lit(w).alias("heading"), F.when(F.col(f"w{i}.styled"), "style").when(F.col(f"w{i}.short"), "short").otherwise("missing").alias("route")) for i, w in enumerate(wanted)))).alias("cell")
    return sums.select(*by, cells).select(*by, "cell.*")


def text_hits(paragraphs: DataFrame, needles: list[str], keep: list[str] = ("idx",)) -> DataFrame:
    """Every (needle, paragraph) pair, case-insensitive, with an excerpt around it."""
    held = paragraphs.select(*keep, collapsed(F.col("text")).alias("__text")).withColumn("__lowered", F.lower("__text"))
    lowered = F.col("__lowered")
    place = lambda n: F.when(lowered.contains(n), F.instr(lowered, F.lit(n)) - 1)
    hits = F.filter(F.array(*(F.struct(F.lit(n).alias("needle"), place(n.lower()).alias("at")) for n in needles)), lambda h: h["at"] >= 0)
    return held.select(*keep, F.col("__text").alias("text"), F.explode(hits).alias("hit")).select(*keep, "hit.needle", excerpt_around(F.col("text"), F.col("hit.at")).alias("excerpt"))


def sizes(paragraphs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Words, paragraphs that are not empty, and headings."""
    words = F.regexp_count("text", F.lit(f"{NOT_WHITE}+"))
    full = F.col("text").rlike(NOT_WHITE)
    return paragraphs.groupBy(*by).agg(F.sum(words).cast("long").alias("words"), F.count_if(full).alias("paragraphs"), F.count_if(full & is_heading_style(F.col("style"))).alias("headings"))


def text_sizes(text: Column) -> Column:
    """Words and paragraphs of a text whose lines are its paragraphs; a row each, so nothing is grouped."""
    full = F.filter(F.split(text, "\n"), lambda p: p.rlike(NOT_WHITE))
    return F.struct(F.regexp_count(text, F.lit(f"{NOT_WHITE}+")).cast("long").alias("words"), F.size(full).cast("long").alias("paragraphs"))


@dataclass(frozen=True)
class SizeBounds:
    """Least and most of what a document has; nothing asserted is an error."""

    least_words: int | None = None
    most_words: int | None = None
    least_paragraphs: int | None = None
    least_headings: int | None = None
    least_tables: int | None = None
    tables: int | None = None

    def __post_init__(self):
        given = [whole(f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None]
        if not given:
            raise UsageError("nothing is asserted")
        if self.least_words is not None and self.most_words is not None and self.least_words > self.most_words:
            raise UsageError("least_words is above most_words")

    def problems(self) -> Column:
        """Names of the bounds that words, paragraphs, headings and tables of a row break, all of them."""
        below = lambda c, n: F.col(c) < F.lit(n)
        tests = {
            "least_words": below("words", self.least_words),
            "most_words": F.col("words") > F.lit(self.most_words),
            "least_paragraphs": below("paragraphs", self.least_paragraphs),
            "least_headings": below("headings", self.least_headings),
            "least_tables": below("tables", self.least_tables),
            "tables": F.col("tables") != F.lit(self.tables),
        }
        broken = F.array(*(F.when(test, name) for name, test in tests.items() if getattr(self, name) is not None))
        return F.filter(broken, lambda x: x.isNotNull())


def opening_tags(html: Column, tag: str) -> Column:
    """Number of opening tags (A10)."""
    return F.regexp_count(html, F.lit(rf"<{tag}(\s[^>]*)?>")).cast("long")
