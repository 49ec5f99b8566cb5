"""Archives by ranges and what office files hold: equal to the standard library's reader, damage told, bytes read counted."""

import io
import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from assay.operators import documents, files, workbooks
from assay.sources import archives, office


def archive(parts, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in parts:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def listed(spark, folder, **contents):
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    return files.list_files(spark, str(folder))


def short(path):
    return path.rsplit("/", 1)[1]


class TestArchives:
    @pytest.mark.filterwarnings("ignore:Duplicate name")
    def test_entries(self, spark, tmp_path, monkeypatch):
        rng = random.Random(5)
        noise = "".join(rng.choice("ab<>é") for _ in range(5000))
        parts = [("a.txt", noise), ("b/ü.txt", ""), ("twice", "first"), ("c", "x" * 3_000_000), ("twice", "last")]
        df = listed(spark, tmp_path, deflated=archive(parts), stored=archive(parts, zipfile.ZIP_STORED, b"PK\x05\x06 a comment"), none=archive([]))
        found = {(short(r.path), r.name): (r.text, r.error) for r in archives.entries(df).collect()}
        want = {"a.txt": noise, "b/ü.txt": "", "twice": "last", "c": "x" * 3_000_000}
        assert found == {(f, n): (t, None) for f in ("deflated", "stored") for n, t in want.items()}
        assert {(short(r.path), r.name) for r in archives.entries(df, r"^[bt]").collect()} == {(f, n) for f in ("deflated", "stored") for n in ("b/ü.txt", "twice")}
        order = [r.name for r in archives.directory(df.filter("path like '%stored'")).orderBy("no").collect()]
        assert order == [n for n, _ in parts]

    def test_one_archive_is_read_by_many_tasks(self, spark, tmp_path):
        """Entries are small rows and large work."""
        found = archives.elements(listed(spark, tmp_path, one=archive([(f"{i}.xml", "<p>x</p>") for i in range(64)])), "", "p")
        assert found.count() == 64
        assert found.select(F.spark_partition_id()).distinct().count() > 1

    def test_refused(self, spark, tmp_path):
        good = archive([("a", "some text" * 50), ("b", "b")])
        at = good.index(b"PK\x01\x02")
        end = good.rindex(b"PK\x05\x06")
        put = lambda place, data: good[:place] + data + good[place + len(data) :]
        wide = good[:end] + b"PK\x06\x07" + bytes(16) + good[end:]
        odd = {"plain": b"no archive", "empty": b"", "cut": good[:-30], "tail": good + b"more", "locked": put(at + 8, b"\x01\x00"), "wide": wide, "huge": put(end + 12, b"\xff\xff\xff\xff"), "divided": put(end + 4, b"\x01\x00"), "signature": put(at, b"PK\x00\x00"), "beyond": put(end + 16, struct.pack("<L", len(good)))}
        found = archives.entries(listed(spark, tmp_path, **odd)).collect()
        none = "no directory of an archive"
        want = {"plain": none, "empty": none, "cut": none, "tail": none, "locked": "encrypted archive", "wide": "64-bit archive", "huge": "64-bit archive", "divided": "divided archive", "signature": "bad directory record", "beyond": "directory beyond the end record"}
        assert {short(r.path): r.error for r in found} == want and all(r.name is None and r.text is None for r in found)

    def test_damaged_entries(self, spark, tmp_path):
        good = archive([("a", "some text" * 50), ("b", "b")])
        at = good.index(b"PK\x01\x02")
        put = lambda place, data: good[:place] + data + good[place + len(data) :]
        odd = {"method": put(at + 10, b"\x0c\x00"), "crc": put(at + 16, b"\x00\x00"), "size": put(at + 24, b"\x07\x00"), "local": put(0, b"QK"), "data": put(31, b"\xff\xff\xff\xff")}
        found = {(short(r.path), r.name): (r.text, r.error) for r in archives.entries(listed(spark, tmp_path, **odd)).collect()}
        assert {f: found[f, "b"] for f in odd} == dict.fromkeys(odd, ("b", None))
        wrong = {f: found[f, "a"] for f in odd}
        assert all(text is None for text, _ in wrong.values())
        differ = "size or checksum of the entry differs"
        assert wrong["data"][1].startswith("bad compressed data") and {f: e for f, (_, e) in wrong.items() if f != "data"} == {"method": "unknown compression", "crc": differ, "size": differ, "local": "bad entry record"}

    def test_bytes_read(self, tmp_path):
        rng = random.Random(1)
        big = bytes(rng.randrange(256) for _ in range(400_000))
        path = tmp_path / "f"
        path.write_bytes(archive([("big", big), ("small", b"few bytes"), ("more", big)], zipfile.ZIP_STORED))
        length, read = path.stat().st_size, []

        class Counted:
            def __init__(self, f):
                self.f = f

            def seek(self, at):
                self.f.seek(at)

            def read(self, n):
                read.append(n)
                return self.f.read(n)

        with open(path, "rb") as f:
            told = [dict(zip(("name", "method", "crc", "packed", "size", "offset"), h, strict=True)) for h in archives.heads(Counted(f), *archives.end_record(Counted(f), length))]
            assert [e["name"] for e in told] == ["big", "small", "more"]
            assert b"".join(archives.inflated(Counted(f), told[1])) == b"few bytes"
        assert sum(read) < archives.END_SIZE + archives.COMMENT + 300

    def test_directory_in_pieces(self, tmp_path, monkeypatch):
        monkeypatch.setattr(archives, "PIECE", 7)
        data = archive([(f"name {i}" * (i % 5 + 1), str(i)) for i in range(50)])
        f = io.BytesIO(data)
        told = list(archives.heads(f, *archives.end_record(f, len(data))))
        assert [t[0] for t in told] == zipfile.ZipFile(io.BytesIO(data)).namelist()
        entry = dict(zip(("name", "method", "crc", "packed", "size", "offset"), told[13], strict=True))
        assert b"".join(archives.inflated(f, entry)) == b"13"

    @pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
    def test_cut_elements(self, size):
        text = '<a><p/>x<p b="1>"/></p><pp>no</pp><p  c="d">one <b/></p><p>two\n<pq/></p><p c="/"></p>< p></p><p'
        pieces = (text[i : i + size] for i in range(0, len(text), size))
        import re

        assert list(archives.cut_elements(pieces, "p")) == re.findall(r"(?s)<p(?:\s[^>]*)?/>|<p(?:\s[^>]*)?>.*?</p>", text)


class TestOffice:
    def test_paragraphs(self, spark, tmp_path):
        xml = '<w:document><w:p><w:t>before</w:t></w:p><w:body w:x="1"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>To</w:t></w:r><w:r><w:t xml:space="preserve">tals &amp; more</w:t></w:r></w:p><w:p/><w:p><w:r><w:delText>old</w:delText><w:t> a  b </w:t></w:r></w:p><w:tbl><w:tr/></w:tbl></w:body><w:p/></w:document>'
        long = "<w:body>" + "".join(f"<w:p><w:t>{'é' * 4000} {i}</w:t></w:p>" for i in range(1000)) + "</w:body>"
        name = "word/document.xml"
        df = listed(spark, tmp_path, f=archive([(name, xml)]), bare=archive([(name, "<w:p><w:t>alone</w:t></w:p>")]), long=archive([(name, long)]), bad=b"x")
        rows = office.document_paragraphs(df).withColumn("f", F.substring_index("path", "/", -1)).cache()
        some = rows.filter("f = 'f'").select("idx", "text", "style")
        assert sorted(tuple(r) for r in some.collect()) == [(1, "Totals & more", "Heading1"), (2, "", ""), (3, "a b", "")]
        assert [tuple(r) for r in rows.filter("f = 'bare'").select("idx", "text").collect()] == [(1, "alone")]
        assert [tuple(r) for r in rows.filter("f = 'long'").agg(F.count("idx"), F.max("idx"), F.count_if(F.expr("text = repeat('é', 4000) || ' ' || (idx - 1)"))).collect()] == [(1000, 1000, 1000)]
        assert [tuple(r) for r in rows.filter("f = 'bad'").select("idx", "text", "error").collect()] == [(None, None, "no directory of an archive")]
        part = archives.entries(df.filter("path like '%/f'"), r"^word/document\.xml$")
        assert part.select(documents.opening_tags(F.col("text"), "w:tbl")).first()[0] == 1
        sizes = documents.sizes(some).first()
        assert (sizes.words, sizes.paragraphs, sizes.headings) == (5, 2, 1)

    def test_workbook(self, spark, tmp_path):
        parts = [
            ("xl/workbook.xml", '<workbook><sheets><sheet name="One &amp; all" sheetId="1" r:id="rId1"/><sheet name="Two" r:id="rId2"/><sheet name="Lost" r:id="rId9"/></sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>'),
            ("xl/sharedStrings.xml", "<sst><si><t>first</t></si><si><r><t>sec</t></r><r><t>ond</t></r></si><si/></sst>"),
            ("xl/worksheets/sheet1.xml", '<sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><v>12.5</v></c><c r="C1" t="s"><v>7</v></c><c t="n"><v>1</v></c></row></sheetData>'),
            ("xl/worksheets/b.xml", '<cols/><c r="A10" t="inlineStr"><is><t>in &lt;line</t></is></c><c r="A11" t="e"><v>#REF!</v></c><c r="A12"/>'),
        ]
        book = archive(parts)
        at = book.rindex(b"PK\x01\x02", 0, book.rindex(b"xl/worksheets/b.xml"))
        df = listed(spark, tmp_path, book=book, g=b"no archive", h=archive([("a", "b")]), i=archive([("xl/workbook.xml", "<workbook/>")]), crc=book[: at + 16] + b"\x00\x00" + book[at + 18 :])
        cells = office.workbook_cells(df.filter("path like '%/book'")).cache()
        want = {("One & all", "A1", "s", "second"), ("One & all", "B1", "n", "12.5"), ("One & all", "C1", "s", ""), ("Two", "A10", "inlineStr", "in <line"), ("Two", "A11", "e", "#REF!"), ("Two", "A12", "n", "")}
        assert {(r.sheet, r.ref, r.type, r.value) for r in cells.collect()} == want
        assert {r.sheet: (r.filled, r.errors) for r in workbooks.scan_cells(cells).collect()} == {"One & all": (2, 0), "Two": (2, 1)}
        problems = {short(r.path): r.problem for r in office.workbook_problems(df).collect()}
        assert problems == {"g": "no directory of an archive", "h": "no workbook part", "i": "no sheets", "crc": "size or checksum of the entry differs"}


def test_no_cells_are_broadcast(spark, tmp_path):
    """Entries are small and their cells many: a size guessed from entries must not send cells or strings to the driver."""
    listed = []
    for n in range(3):
        path = str(tmp_path / f"{n}.xlsx")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", '<sheets><sheet name="S" r:id="r"/></sheets>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationship Id="r" Target="worksheets/sheet1.xml"/>')
            z.writestr("xl/sharedStrings.xml", "".join(f"<si><t>{n}-{i}</t></si>" for i in range(5000)))
            z.writestr("xl/worksheets/sheet1.xml", "".join(f'<c r="A{i + 1}" t="s"><v>{i}</v></c>' for i in range(5000)))
        listed.append((path, os.path.getsize(path)))
    cells = office.workbook_cells(spark.createDataFrame(listed, "path string, length long"))
    assert len({r.value for r in cells.collect()}) == 15000
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
