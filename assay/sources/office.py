"""Word and Excel files: paragraphs, shared strings, cells, sheet maps, entities.

Archives are read by ranges (``archives``); elements of their parts are rows, and what they hold is extracted by column
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import collapsed
from assay.sources.archives import elements, wanted

# The entities that office text uses.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
ENTITY = r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);"


def entity_text(entity: Column) -> Column:
    """The character of one entity; one that is not known, or no character, stays as it is."""
    name = F.lower(F.substr(entity, F.lit(2), F.length(entity) - 2))
    digits = F.regexp_extract(name, r"^#x?0*([0-9a-f]*)\z", 1)
    point = F.when(name.startswith("#x"), F.conv(digits, 16, 10)).when(digits.rlike(r"^[0-9]*\z"), digits).try_cast("bigint")
    sound = (F.length(digits) <= 7) & (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    out = F.when(name.startswith("#"), F.when(sound, character).otherwise(entity))
    for known, text in NAMED.items():
        out = out.when(name == known, F.lit(text))
    return out.otherwise(entity)


def decode_entities(text: Column) -> Column:
    """One pass, so that ``&amp;lt;`` stays ``&lt;``: what stands between entities, and each entity's text."""
    between, entities = F.split(text, ENTITY), F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), entity_text)
    return F.when(text.contains("&"), F.array_join(F.zip_with(between, entities, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def inner_texts(xml: Column, tag: str) -> Column:
    """The decoded texts inside all elements of a tag, joined."""
    parts = F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.array_join(F.transform(parts, decode_entities), "")


def attribute(element: Column, name: str) -> Column:
    """An attribute of an element's opening tag; null if it has none."""
    head = F.regexp_extract(element, r"(?s)^<[^>]*>", 0)
    return F.when(head.rlike(rf'\s{name}="'), decode_entities(F.regexp_extract(head, rf'\s{name}="([^"]*)"', 1)))


def paragraph(element: Column) -> Column:
    """Text and style of a paragraph; deletions are left out, white space is collapsed."""
    kept = F.regexp_replace(element, r"(?s)<w:delText(?:\s[^>]*)?>.*?</w:delText>", "")
    style = F.coalesce(decode_entities(F.regexp_extract(kept, r'<w:pStyle\s[^>]*w:val="([^"]*)"', 1)), F.lit(""))
    return F.struct(collapsed(inner_texts(kept, "w:t")).alias("text"), style.alias("style"))


def cell(element: Column) -> Column:
    """ref, type and value of a cell; a shared string's value is still its index."""
    kind = F.coalesce(attribute(element, "t"), F.lit("n"))
    value = F.when(kind == "inlineStr", inner_texts(element, "t")).otherwise(inner_texts(element, "v"))
    return F.struct(attribute(element, "r").alias("ref"), kind.alias("type"), value.alias("value"))


def document_paragraphs(files: DataFrame) -> DataFrame:
    """path, idx, text, style of the paragraphs of documents(path, length), idx from 1 (S10); a row each, so that a long
    document is in no one cell. A document that cannot be read has one row with its error."""
    found = elements(files, r"^word/document\.xml$", "w:p", within="w:body")
    return found.select("path", F.col("no").alias("idx"), paragraph(F.col("element")).alias("p"), "error").select("path", "idx", "p.text", "p.style", "error")


def sheet_names(files: DataFrame) -> DataFrame:
    """path, name, rid of the sheets of workbooks(path, length)."""
    found, e = elements(files, r"^xl/workbook\.xml$", "sheet"), F.col("element")
    return found.filter("element is not null").select("path", attribute(e, "name").alias("name"), attribute(e, "r:id").alias("rid"))


def relations(files: DataFrame) -> DataFrame:
    """path, rid, target of the workbooks' relationships."""
    found, e = elements(files, r"^xl/_rels/workbook\.xml\.rels$", "Relationship"), F.col("element")
    return found.filter("element is not null").select("path", attribute(e, "Id").alias("rid"), attribute(e, "Target").alias("target"))


def strings(files: DataFrame) -> DataFrame:
    """path, idx (from 0), text of the shared strings; a missing part has none."""
    found = elements(files, r"^xl/sharedStrings\.xml$", "si").filter("element is not null")
    return found.select("path", (F.col("no") - 1).alias("idx"), inner_texts(F.col("element"), "t").alias("text"))


def workbook_cells(files: DataFrame) -> DataFrame:
    """path, sheet, ref, type, value of all cells of workbooks(path, length) (S14): parts of one file meet by
    its path and the part's name, shared strings by their index; all by merging, as Spark takes cells for small as their entries
    and would broadcast them. Workbooks of :func:`workbook_problems` have no sound cells."""
    from assay.operators.workbooks import shared_strings, sheet_map

    where = sheet_map(sheet_names(files), relations(files), ["path"]).select("path", F.col("name").alias("sheet"), F.col("target_path").alias("name"))
    held = elements(files, r"^xl/worksheets/[^/]+\.xml$", "c").filter("element is not null").select("path", "name", cell(F.col("element")).alias("c"))
    found = held.select("path", "name", "c.*").filter(F.col("ref").rlike(r"^[A-Z]+[0-9]+\z"))
    return shared_strings(found.join(where.hint("merge"), ["path", "name"]).select("path", "sheet", "ref", "type", "value"), strings(files), ["path"])


def workbook_problems(files: DataFrame) -> DataFrame:
    """path, problem: archives and parts that cannot be read, and workbooks without a workbook part or without sheets."""
    parts = wanted(files, r"^xl/workbook\.xml$").groupBy("path").agg(F.max("error").alias("refused"), F.count("name").alias("parts"))
    sheets = elements(files, r"^xl/(workbook\.xml|_rels/workbook\.xml\.rels|sharedStrings\.xml|worksheets/[^/]+\.xml)$", "sheet")
    told = sheets.groupBy("path").agg(F.max("error").alias("broken"), F.count_if((F.col("name") == "xl/workbook.xml") & F.col("element").isNotNull()).alias("sheets"))
    both = files.select("path").join(parts, "path", "left").join(told, "path", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    problem = F.coalesce("refused", F.when(none("parts"), "no workbook part"), "broken", F.when(none("sheets"), "no sheets"))
    return both.select("path", problem.alias("problem")).filter("problem is not null")
