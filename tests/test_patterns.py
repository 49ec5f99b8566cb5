"""Patterns that can run away are refused; others pass, and at once."""

import random
import re
import time

import pytest

from assay.config import UsageError
from assay.functions.patterns import refuse_runaway
from assay.operators import documents, ledger, logs

RUNAWAY = [r"(a+)+$", r"(a*)*b", r"(a|a)*$", r"(a|aa)+$", r"(\w+\s?)+$", r"^(.*,)*x", r"([a-z]+)*\d", r"(?:(?:x+)+y?)+z", r"(a+b?)+$", r"((a)|(\w))*!", r"(?>(a+)+$)", r"(?=(a+)+b)", r"(x{1,20})+y", r"(\d+|\w+)*!", r"(a{1,9}){9,}b", r"(.|\s)*end", r"(é|\w)+$"]
HARMLESS = ["", "error", r"\berror\b", r"(\w+\s)+$", r"(a|b)*c", r"^\s*(ok|done)\s*$", r"(?:\d{1,3}\.){3}\d{1,3}", r"[^,]*(,[^,]*)*$", r"\d{4}-\d{2}-\d{2}", r".*total: 12.*", r"a+b+a+", r"(ab|cd)+?", r"(?:a(?!b))*", r"(a++)+b", r"(\"[^\"]*\"|'[^']*')+", r"x*?y", r"(a)\1+", r"(?i:error|fail)+", r"^(?:[a-z]+=\d+;)*$", r"(\d+\.)*\d+"]


@pytest.mark.parametrize("source", RUNAWAY)
def test_refused(source):
    with pytest.raises(UsageError, match="exponential"):
        refuse_runaway(source)


@pytest.mark.parametrize("source", HARMLESS)
def test_passes(source):
    refuse_runaway(source)


def test_flags_count():
    refuse_runaway("(a|A)*$")
    with pytest.raises(UsageError):
        refuse_runaway("(a|A)*$", "i")
    refuse_runaway(r"(.|\n)*$")
    with pytest.raises(UsageError):
        refuse_runaway(r"(.|\n)*$", "s")


def test_flags_of_a_group_count():
    refuse_runaway("a(?i:b)(a|A)*$")
    with pytest.raises(UsageError):
        refuse_runaway("(?:a|A)(?i:(a|A)*)$")


def test_what_is_refused_does_run_away_and_what_passes_does_not():
    """Matched against texts of growing length: refused ones double at each step, the others stay quick."""
    began = time.process_time()
    re.search(r"(a+)+$", "a" * 22 + "!")
    assert time.process_time() - began > 0.05
    for source in HARMLESS:
        for text in ("a" * 2000 + "!", "ab" * 1000 + "!", "1.1" * 500 + "!", "a=1;" * 500 + "!"):
            began = time.process_time()
            re.search(source, text)
            assert time.process_time() - began < 5, source


def test_given_patterns_are_judged():
    for bad in (lambda: logs.LogScan(require=(r"(a+)+$",)), lambda: logs.LogScan(control=("x",), forbid=(r"(\w+\s?)+$",)), lambda: logs.LogScan(require=("(",)), lambda: refuse_runaway("a" * 3000), lambda: refuse_runaway("(" * 2000 + ")" * 2000)):
        with pytest.raises(UsageError):
            bad()
    for _, pattern in documents.DOCUMENT_PLACEHOLDERS:
        refuse_runaway(pattern)


def test_expectations_are_judged(spark):
    df = spark.createDataFrame([("total: 12",), ("a" * 30_000 + "!",)], "o string")
    with pytest.raises(UsageError):
        df.select(ledger.matches(df.o, "/(a+)+$/"))
    began = time.time()
    assert [r[0] for r in df.select(ledger.matches(df.o, "/TOTAL: \\d+/i")).collect()] == [True, False]
    assert time.time() - began < 60


def test_literal_core():
    from assay.functions.patterns import literal_core
    from assay.operators.documents import CELL_PLACEHOLDERS, DOCUMENT_PLACEHOLDERS

    cores = {
        "abc": ("abc", False), "(?i)aBc": ("abc", True), "a|b": None, "(ab)c+d": ("d", False), "ab?cd": ("cd", False), "a{0,2}": None, r"x\.y\s*z": ("x.y", False),
        "(?i)aéb": ("a", True), "(?iu)sk": None, "(?x)a b": None, "(?=ab)c": ("c", False), "(": None, "": None, r"\Qa.b\E": None, r"^ab$": ("ab", False), "[a]bc": ("abc", False),
    }
    assert {p: literal_core(p) for p in cores} == cores
    assert all(literal_core(p) for _, p in DOCUMENT_PLACEHOLDERS + CELL_PLACEHOLDERS)


def test_placeholders_equal_their_patterns(spark):

    from pyspark.sql import functions as F

    from assay.operators.documents import CELL_PLACEHOLDERS, DOCUMENT_PLACEHOLDERS, first_placeholder, placeholder_hits

    parts = ["TODO", "todo", "tOdOs", "TBD", "xxx", "OOO", "ooo", "○○○", "lorem", "LOREM", " ", "\n", "ipsum", "<", ">", "/", "[[", "]]", "{{", "}}", "여기에", "내용을", "입력", "작성", "기재", "요망", "a", "İ", "FIXME", "K", "1", ""]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "idx int, text string")
    found = sorted((r.idx, r.label) for r in placeholder_hits(df).collect())
    java = lambda p: re.compile(p, re.ASCII)
    assert found == sorted((i, label) for i, t in enumerate(texts) if t is not None for label, p in DOCUMENT_PLACEHOLDERS if java(p).search(t))
    cells = {r.idx: r.label for r in df.select("idx", first_placeholder(F.col("text")).alias("label")).collect()}
    assert cells == {i: next((label for label, p in CELL_PLACEHOLDERS if t is not None and java(p).search(t)), None) for i, t in enumerate(texts)}
