"""Files in blocks against the same files taken whole, at every size of block."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.config import UnusableInput, UsageError
from assay.operators import files, logs
from assay.sources import blocks, delimited
from assay.sources.delimited import Dialect, Records, split_records

HARD = ["", "a", "a,b\n", "a,b\r\nc,d", '"a""b",c\n"x\ny",z\n', '"', 'a\n"b', '"a"b"c,d\n', 'a"b,c"\n', "\n\n\r\r\n\r", '""\n"",""\n', ",\n,", '"a\r\n"\r\n', '"a",', "é,ü\r\n日本,\"本\n\"\n", '"a"\r', 'x\r"y\r\nz"']


def walk(machine, data: bytes, size: int):
    """State at the end, records ended and where records begin after blocks, composed as the scan composes them."""
    pieces = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    rows = pd.DataFrame([(*blocks.outcomes(machine, x, i * size), *blocks.utf8_piece(x)) for i, x in enumerate(pieces)], columns=["exits", "counts", "firsts", "head", "solid", "good", "tail"])
    exits, counts, firsts, piece = blocks.compose(rows, machine.states)
    state, begins = 0, []
    for row in rows.itertuples():
        if row.counts[state]:
            begins.append(row.firsts[state])
        state = row.exits[state]
    assert state == exits[0] and (begins[:1] or [-1])[0] == firsts[0]
    return state, counts[0], begins, blocks.utf8_whole(piece)


def texts(alphabet: str, n: int):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("delimiter", [",", "\t", "|"])
def test_machine_of_records(delimiter):
    """From the places that the machine names on, the text splits into the records that it has as a whole."""
    for text in [*(x.replace(",", delimiter) for x in HARD), *texts('aé",\r\n'.replace(",", delimiter), 1500)]:
        want, error = split_records(text, delimiter)
        data, machine = text.encode(), Records(delimiter)
        for size in (1, 2, 3, 5, 1000):
            state, ended, begins, _ = walk(machine, data, size)
            assert (state == 2) == (error is not None), (text, size)
            if error:
                assert error == f"unterminated quoted field starting at row {ended + 1}", (text, size)
                continue
            got, cuts = [], [0, *begins, len(data)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                # the number of a split's first record follows from what ended before it
                before = walk(machine, data[:a], size)
                no = before[1] + 1 + (before[0] == 4)
                got += [(no + k - 1, cells) for k, cells in split_records(data[a:b].decode(), delimiter)[0]]
            assert got == want, (text, size)


def test_machine_of_lines():
    for text in [*HARD, *texts("aé \r\n", 1500)]:
        data = text.encode()
        lines = blocks.Lines.END.split(data)
        for size in (1, 2, 3, 1000):
            state, ended, begins, _ = walk(blocks.Lines(), data, size)
            assert ended + (state == 1) == len(lines) - 1, (text, size)
            assert all(data[b - 1 : b] in (b"\n", b"\r") and data[b - 1 : b + 1] != b"\r\n" for b in begins)


def test_utf8_in_pieces():
    rng = random.Random(1)
    good = ["", "abc", "é", "日本語", "a🙂b", "é" * 9]
    bad = [b"\x80", b"\xc3", b"\xe6\x97", b"a\xffb", b"\xc0\xaf", b"\xed\xa0\x80", b"\x80" * 9, b"\xc3\xc3\xa9", b"\xf0\x9f\x99\x82\x82"]
    for data in [*(g.encode() for g in good), *bad, *(bytes(rng.choice(b"a\xc3\xa9\xf0\x9f\x99\x82") for _ in range(rng.randint(1, 9))) for _ in range(3000))]:
        try:
            valid = data.decode() is not None
        except UnicodeDecodeError:
            valid = False
        for size in (1, 2, 3, 4, 50):
            assert walk(blocks.Lines(), data, size)[3] == valid, (data, size)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("blocks")
    given = {f"f{i}.csv": x.encode() for i, x in enumerate(HARD)}
    given |= {"a b%20é.csv": b"k,v\n1,2\n", "mark.csv": b'\xef\xbb\xbf"k",v\n1,"2\n3"\n', "korean.csv": "이름,값\n정상,\"오\n류\"\n".encode("cp949"), "garbled.csv": "k,v\nÃ©,1\n".encode()}
    for name, content in given.items():
        (top / name).write_bytes(content)
    return str(top), given


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_delimited_files(spark, folder, size, monkeypatch):
    """Files in blocks, a few to a chunk, have the records of files in a cell, and say the same of each file."""
    monkeypatch.setattr(blocks, "FAN", 3)
    path, given = folder
    told, data = delimited.load_blocks(files.list_files(spark, path), block_bytes=size)
    whole = delimited.load(files.read_files(spark, path))
    name = lambda p: p.rsplit("/", 1)[1]
    have = {name(r.path): (r.encoding, r.bom, r.header, r.width, r.error) for r in told.collect()}
    want = {name(r.path): (r.encoding, r.bom, r.header if r.error is None else None, r.width if r.error is None else None, r.error) for r in whole.collect()}
    assert have.keys() == want.keys() == given.keys()
    for k, v in have.items():
        assert (v if v[4] is None else (*v[:2], None, None, v[4])) == want[k], k
    assert have["mark.csv"][:3] == ("utf8", True, ["k", "v"]) and have["korean.csv"][0] == "cp949"
    rows = lambda df: sorted((name(r.path), r.no, r.cells) for r in df.collect())
    assert rows(data) == rows(delimited.rows(whole))


def test_delimited_without_header(spark, folder):
    told, data = delimited.load_blocks(files.list_files(spark, folder[0], "a b*"), Dialect(header=False), "utf8", 3)
    assert [(r.header, r.n_records) for r in told.collect()] == [(None, 2)]
    assert sorted((r.no, r.cells) for r in data.collect()) == [(1, ["k", "v"]), (2, ["1", "2"])]


def test_refusals(spark, folder):
    listed = files.list_files(spark, folder[0])
    for bad in (lambda: Records("｜"), lambda: Records("x"), lambda: blocks.scan(listed, blocks.Lines(), 0), lambda: blocks.last_lines(listed, 0), lambda: blocks.last_lines(listed, 3, "auto"), lambda: blocks.with_encoding(listed, "latin1")):
        with pytest.raises(UsageError):
            bad()
    with pytest.raises(UnusableInput):
        blocks.opened("nosuchstore://x/y")


def test_files_of_any_name_are_listed_once(spark, folder, tmp_path):
    for name in ("a b.csv", "é%20.csv", "100%.csv", "empty one.csv"):
        (tmp_path / name).write_bytes(b"" if name.startswith("empty") else b"x")
    for df in (files.read_files(spark, str(tmp_path)), files.list_files(spark, str(tmp_path))):
        assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in df.collect()) == sorted([("a b.csv", 1), ("é%20.csv", 1), ("100%.csv", 1), ("empty one.csv", 0)])
    assert files.read_files(spark, str(tmp_path)).filter("content is null").isEmpty()


@pytest.mark.parametrize("size", [1])
def test_logs(spark, tmp_path, size):
    text = "first\r\n\r\n 　\r\nsecond é\rthird\n\nfourth"
    (tmp_path / "a.log").write_bytes(text.encode())
    (tmp_path / "b.log").write_bytes("정상 종료\r\n오류".encode("cp949"))
    (tmp_path / "empty.log").write_bytes(b"")
    rows = blocks.lines(files.list_files(spark, str(tmp_path)), block_bytes=size).collect()
    by = lambda x: sorted((r.number, r.text) for r in rows if r.path.endswith(x))
    assert by("a.log") == [(1, "first"), (4, "second é"), (5, "third"), (7, "fourth")]
    assert by("b.log") == [(1, "정상 종료"), (2, "오류")] and by("empty.log") == []
    whole = spark.createDataFrame([(text,)], "t string").selectExpr("t").select(logs.log_lines("t").alias("l")).first().l
    assert [(x.number, x.text) for x in whole] == by("a.log")
    last = blocks.last_lines(files.list_files(spark, str(tmp_path), "a.log"), 2, block_bytes=size).collect()
    assert sorted((r.from_end, r.text) for r in last) == [(1, "fourth"), (2, "third")]
    every = blocks.last_lines(files.list_files(spark, str(tmp_path), "a.log"), 99, block_bytes=size).collect()
    assert sorted((r.from_end, r.text) for r in every) == [(1, "fourth"), (2, "third"), (3, "second é"), (4, "first")]


def test_a_tail_reads_the_end_alone(spark, tmp_path):
    lines = [f"line {i} " + "x" * 50 for i in range(20_000)]
    (tmp_path / "big.log").write_bytes("\n".join(lines).encode())
    (tmp_path / "small.log").write_bytes(b"one\n")
    listed = files.list_files(spark, str(tmp_path))
    read = {r.path.rsplit("/", 1)[1]: r.stop - r.start for r in blocks.last_ranges(listed, 100, block_bytes=4096).collect()}
    assert read == {"big.log": 2 * 4096, "small.log": 4}  # 100 lines of about 60 bytes
    found = blocks.last_lines(listed, 100, block_bytes=4096).filter("path like '%big.log'").collect()
    assert [r.text for r in sorted(found, key=lambda r: -r.from_end)] == lines[-100:]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """Splits are small rows and large work, and no record is sent to its file's task."""
    (tmp_path / "one.csv").write_text("".join(f"{i},x\n" for i in range(3000)))
    _, data = delimited.load_blocks(files.list_files(spark, str(tmp_path)), block_bytes=64)
    assert data.count() == 2999
    assert data.select(F.spark_partition_id()).distinct().count() > 1
