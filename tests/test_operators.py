"""Operators on small fixtures: file formats, ledgers, lifecycles, claims, contracts, numbers."""

from datetime import datetime

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.config import UsageError
from assay.functions import encoding, numbers, paths, text
from assay.operators import audit, coordination, documents, files, ledger, logs, tabular, workbooks
from assay.sources import delimited, ledgers, office, state


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


class TestFunctions:
    def test_a_number_is_parsed_from_a_text_made_once(self, spark):
        assert str(numbers.parse_number(F.col("amount"))).count("amount") == 1

    def test_parse_number(self, spark):
        given = ["1,234.56", "(500)", "abc", "0", " ", "1 2", "(-5)", "-$5", "$-5", "5.", ".5", "1e5", "15%", "(1,000)%", "+-5", "()", "€5"]
        want = [1234.56, -500, None, 0, None, 12, 5, -5, None, None, 0.5, None, 15, None, None, None, None]
        assert [None if x is None else float(x) for x in column(spark, given, numbers.parse_number)] == want

    def test_cell_row(self, spark):
        assert column(spark, ["A1", "B12345678", "B60000000", "AB9876543210", "A", ""], text.cell_row) == [1, 12345678, 60000000, 9876543210, None, None]

    def test_globs(self, spark):
        pairs = [("src/api", "src/api/**"), ("src/api/**", "src/web/**"), ("a*", "ab*"), ("./src/x", "src/x"), ("src//x", "src/./x"), ("../q", "z"), ("/abs", "z"), ("", "z"), ("src/a", "src/ab"), ("src", "src/a/b"), ("a/*/c", "a/b/d")]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
        assert [r[0] for r in df.select(paths.globs_overlap(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, True, True, True, True, False, True, True]

    def test_encodings(self, spark):
        given = ["정상".encode("cp949"), b"\xff\xfea\0", "hello world, abc".encode("utf-16le"), "hello world, abc".encode("utf-16be"), b"\0\0\0\0ab\0cd\0efghijklmn", b"\xef\xbb\xbfabc", b"\xef\xbb\xbf\xc1\xa4", b"", "é".encode(), b"abc", b"\xc1\xa4\xbb\xf3"]
        want = ["cp949-or-binary", "utf-16le", "utf-16le", "utf-16be", "utf-16?", "utf-8-bom", "cp949-or-binary", "ascii", "utf-8", "ascii", "cp949-or-binary"]
        assert column(spark, map(bytearray, given), encoding.encoding_class, "binary") == want
        decoded = column(spark, map(bytearray, given[:1]), encoding.decoded, "binary")[0]
        assert (decoded.text, decoded.encoding, decoded.bom) == ("정상", "cp949", False)

    def test_mojibake_decoding(self, spark):
        assert column(spark, ["utf-8", "cp949-or-binary", "utf-16le"], lambda c: encoding.mojibake_decoding(None, c)) == ["utf8", "cp949", None]
        assert column(spark, ["utf-8", "utf-16le"], lambda c: encoding.mojibake_decoding("cp949", c)) == ["cp949", None]

    def test_entities(self, spark):
        given = ["a &amp;lt; &#54620; &#x1F600; &copy; &#xD800; &NBSP;|", "plain", "&amp;", "&#X41;&#0065;&#99999999;", None]
        assert column(spark, given, office.decode_entities) == ["a &lt; 한 😀 &copy; &#xD800; \u00a0|", "plain", "&", "AA&#99999999;", None]

    def test_excerpts(self, spark):
        assert column(spark, ["  " + "x" * 121, " short "], text.log_excerpt) == ["x" * 117 + "...", "short"]
        assert column(spark, ["a  b " + "x" * 60, "a \n b"], text.cell_excerpt) == [("a b " + "x" * 60)[:60] + "...", "a b"]
        long = "0123456789" * 20
        for at in (0, 12, 13, 100, 190):
            shown = column(spark, [long], lambda c, at=at: text.excerpt_around(c, F.lit(at)))[0]
            bare = shown.removeprefix("...").removesuffix("...")
            assert len(shown) <= 60 and bare in long and long.index(bare) % 10 == max(0, at - 12) % 10
            assert shown.startswith("...") == (at > 12)

    def test_lines_and_lists(self, spark):
        assert column(spark, ["a\n\nb\nc\nd\ne\nf\ng\nh\ni", "a\n b ", " \n"], text.failure_summary) == ["a | b | c | d | e | f | ... | h | i", "a | b", "(no output)"]
        assert column(spark, ["a\nb\n\n c \n", "x", ""], text.last_lines) == ["b | c", "x", "(no output)"]
        assert column(spark, [["b", "a", "b"]], text.distinct_in_order, "array<string>") == [["b", "a"]]
        assert column(spark, [12.5, -0.0, 100.0, 1.0000001], numbers.shown_number, "double") == ["12.5", "0", "100", "1"]
        assert column(spark, ["2024-01-01T00:00:00Z", "soon", None], text.is_time) == [True, False, False]
        assert numbers.tolerance("1,000.5") == 1000.5
        with pytest.raises(UsageError):
            numbers.tolerance("-1")

    def test_search_path(self, spark):
        assert column(spark, ["/a:/b::/c"], lambda c: audit.search_path(c)["entries"]) == [3]


class TestDelimited:
    def records(self, spark, given, dialect=None):
        return [[(r.no, r.cells) for r in x.records] if x.error is None else x.error for x in column(spark, given, lambda c: delimited.records(c, dialect or delimited.Dialect()))]

    def test_dialect(self, spark):
        given = ['a,b\r\n1,"x, y"\r\n2,"two\nlines"\r\n', "a\n\n b\n", '"a""b",c"d\n', 'x"y,"q"z,\n', 'a,"open\nb', "a\rb\n", 'a,b,', '""\nx', "", None, "   \n"]
        want = [
            [(1, ["a", "b"]), (2, ["1", "x, y"]), (3, ["2", "two\nlines"])], [(1, ["a"]), (3, [" b"])], [(1, ['a"b', 'c"d'])], [(1, ['x"y', "qz", ""])],
            "unterminated quoted field starting at row 1", [(1, ["a"]), (2, ["b"])], [(1, ["a", "b", ""])], [(2, ["x"])], [], [], [(1, ["   "])],
        ]
        assert self.records(spark, given) == want
        assert self.records(spark, ["a\tb;c"], delimited.Dialect("tab")) == [[(1, ["a", "b;c"])]]
        with pytest.raises(UsageError):
            delimited.Dialect('"')

    def test_load(self, spark, tmp_path):
        given = {"ok.csv": "\ufeffid , amount\n1,\"1,000\"\n2\n".encode(), "bad.csv": b'id\n"x', "cp949.csv": "거래,금액\n1,2\n".encode("cp949"), "empty.csv": b"", "twice.csv": b"a,a\n1,2\n", "garbled.csv": "a\nÃ©\n".encode()}
        for name, data in given.items():
            (tmp_path / name).write_bytes(data)
        loaded = delimited.load(files.read_files(spark, str(tmp_path), "*.csv")).cache()
        by = {r.path.rsplit("/", 1)[1]: r for r in loaded.collect()}
        assert by["ok.csv"].header == ["id", "amount"] and by["ok.csv"].width == 2 and by["ok.csv"].bom
        assert (by["cp949.csv"].header, by["cp949.csv"].encoding) == (["거래", "금액"], "cp949")
        assert {n: r.error for n, r in by.items() if r.error} == {"bad.csv": "unterminated quoted field starting at row 2", "empty.csv": "no records", "garbled.csv": "mojibake"}
        rows = delimited.rows(loaded).filter(F.col("path").endswith("ok.csv")).withColumn("amount", delimited.cell(1)).collect()
        assert [(r.no, r.amount) for r in rows] == [(2, "1,000"), (3, "")]
        total = tabular.total(delimited.rows(loaded).filter(F.col("path").endswith("ok.csv")), delimited.cell(1)).first()
        assert (float(total.total), total.counted, total.blanks) == (1000.0, 1, 1)
        assert {(r.rule, r.subject) for r in delimited.load_findings(loaded).collect() if r.rule == "ambiguous-column"} == {("ambiguous-column", "a")}
        wanted = spark.createDataFrame([(r.path,) for r in loaded.collect()] + [("gone",)], "path string")
        states = files.file_states(wanted, files.read_files(spark, str(tmp_path))).groupBy("state").count().collect()
        assert {r.state: r["count"] for r in states} == {"measured": 6, "unusable": 1}


LEDGER = """# Title
OWNS: src/api, ./docs/*, ../up
- [x] G1: All totals agree
  CHECK: run totals
  EXPECT: /total: \\d+/i
  EVIDENCE: exit=0; EXPECT=matched
  DEPS: a/b.txt, ./c.txt
- [ ] G2: Someone looks
```
- [ ] HIDDEN: not a gate
```
- [x] G3: Given up
ABANDON: G3 no time left
  CHECK: lost
- [x] G4:
  CHECK: only
  CHECK: twice
"""
BAD = """- [ ] no id here
- [x] G1: a
- [x] G1: b
  DEPS: x
  ABANDON: G1 indented
CHECK: outside
OWNS: late
- [ ] b@d: c
  CHECK:
  EXPECT: /(/
- [ ] P: path
  CHECK: c
  EXPECT: /src/a.b/
  DEPS: ../x, a*, 
  DEPS: ,
ABANDON:
ABANDON: Z
ABANDON: Q: why
ABANDON: Q again
~~~
open
"""


class TestLedger:
    def parsed(self, spark, given):
        return ledgers.parse(spark.createDataFrame(list(given.items()), "file string, text string"))

    def test_gates(self, spark):
        found = self.parsed(spark, {"a.md": LEDGER.replace("\n", "\r\n"), "b.md": "# nothing"})
        gates = {r.id: r for r in found.gates.collect()}
        assert {k: (r.line, r.checked, r.state, r.runnable) for k, r in gates.items()} == {"G1": (3, True, "met", True), "G2": (8, False, "unmet", False), "G3": (12, True, "abandoned", False), "G4": (15, True, "unmet-no-evidence", True)}
        one = gates["G1"]
        assert (one.title, one.check, one.deps, one.expectation.kind, one.expectation.flags) == ("All totals agree", "run totals", ["a/b.txt", "c.txt"], "regex", "i")
        assert gates["G3"].reason == "no time left" and gates["G4"].check == "twice"
        assert {r.path for r in found.owns.collect()} == {"src/api", "docs/*"}
        problems = {(r.file, r.rule, r.subject) for r in found.problems.collect()}
        want = {("a.md", "owns-traversal", "../up"), ("a.md", "orphan-attribute", "check"), ("a.md", "blank-title", "G4"), ("a.md", "duplicate-attribute", "check"), ("a.md", "check-and-expect-belong-together", "G4"), ("b.md", "no-gates", None)}
        assert problems == want

    def test_problems(self, spark):
        found = self.parsed(spark, {"bad.md": BAD}).problems.collect()
        rules = sorted((r.rule, r.line) for r in found)
        want = [
            ("gate-without-id", 1), ("duplicate-id", 3), ("indented-abandon", 5), ("unindented-attribute", 6), ("owns-after-gate", 7), ("invalid-id", 8), ("blank-check-or-expect", 8), ("expect-invalid", 8),
            ("check-and-expect-belong-together", 8), ("path-read-as-regex", 11), ("deps-traversal", 14), ("deps-pattern", 14), ("duplicate-attribute", 15), ("deps-empty", 15), ("abandon-without-id", 16), ("abandon-without-reason", 17),
            ("duplicate-abandon", 19), ("unknown-abandon", 18), ("unclosed-fence", None), ("deps-on-manual-gate", 3),
        ]
        assert sorted(rules, key=str) == sorted(want, key=str)
        assert [r.rule for r in found if r.level == "warning"] == ["path-read-as-regex"]
        assert {r.subject for r in found if r.rule == "duplicate-id"} == {"G1:2"}

    def test_lint(self, spark):
        rows = [("f", "A", None, None, "Has 3 parts", False), ("f", "B", "", None, "plain", False), ("f", "C", "echo ok", "ok", "Improve it", False), ("f", "D", "echo a | b", "total", "Improved", False), ("f", "E", "true", "yes", "x", True)]
        gates = spark.createDataFrame(rows, "file string, id string, check string, expect string, title string, abandoned boolean")
        assert {(r.id, r.rule) for r in ledger.lint(gates).collect()} == {("A", "manual-gate"), ("A", "unmeasured-number"), ("B", "manual-gate"), ("C", "tautological-check"), ("C", "weak-expect"), ("C", "activity-not-outcome")}
        ratio = ledger.mostly_manual(gates).first()
        assert (ratio.live, ratio.runnable, ratio.mostly_manual) == (4, 2, False)
        report = audit.lint_report(ledger.lint(gates), strict=True).first()
        assert report.n == 6 and report.status == 1

    def test_deps(self, spark):
        gates = spark.createDataFrame([("f", "A", ["x", "y"]), ("f", "B", ["x"])], "file string, id string, deps array<string>")
        digests = spark.createDataFrame([("x", "1"), ("y", None)], "path string, sha256 string")
        assert [tuple(r) for r in ledger.unreadable_deps(gates, digests).collect()] == [("f", "A", "y")]


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


WAVE = {"wave": "w", "state": "complete", "leaves": ["a", "b"], "opened_at": at(0), "sealed_at": at(3), "completed_at": at(6), "abandoned_at": None, "reason": None, "started": {"a": {"handle": "h1", "at": at(1)}, "b": {"handle": "h2", "at": at(2)}}, "returned": {"a": at(4), "b": at(5)}}
KIND = "wave string, state string, leaves array<string>, opened_at timestamp, sealed_at timestamp, completed_at timestamp, abandoned_at timestamp, reason string, started map<string, struct<handle: string, at: timestamp>>, returned map<string, timestamp>"
SEALED = {"state": "sealed", "completed_at": None, "returned": {"a": at(4)}}
OPEN = {"state": "open", "sealed_at": None, "completed_at": None, "returned": {}}
GONE = {"state": "abandoned", "completed_at": None, "returned": {"a": at(4)}, "abandoned_at": at(9), "reason": "no time"}


class TestCoordination:
    CASES = [
        ({}, set()), (SEALED, set()), (OPEN, set()), (GONE, set()),
        ({"leaves": []}, {"no-leaves", "unknown-start", "sealed-with-missing-starts", "complete-with-missing-returns"}),
        ({**OPEN, "leaves": ["a", "b", "b"]}, {"duplicate-leaves"}),
        ({"state": "paused"}, {"invalid-state", "stray-seal", "stray-completion"}),
        ({"started": {"a": {"handle": "h", "at": at(1)}, "b": {"handle": "h", "at": at(2)}}}, {"handle-reused"}),
        ({"started": {"a": {"handle": " ", "at": at(1)}, "b": {"handle": "h", "at": at(2)}}}, {"invalid-handle"}),
        ({"opened_at": at(2)}, {"start-before-open"}),
        ({"opened_at": None}, {"missing-time"}),
        ({**SEALED, "sealed_at": at(1)}, {"sealed-before-last-start"}),
        ({**SEALED, "returned": {"b": at(1)}}, {"return-before-own-start", "return-before-seal"}),
        ({**OPEN, "returned": {"a": at(4)}}, {"open-with-returns", "return-without-seal"}),
        ({**SEALED, "returned": {"a": at(4), "b": at(5)}}, {"sealed-yet-returned"}),
        ({"completed_at": at(4)}, {"complete-before-last-return"}),
        ({**GONE, "abandoned_at": at(3)}, {"abandoned-before-last-transition"}),
        ({**GONE, "reason": " "}, {"abandoned-without-reason"}),
        ({**GONE, "returned": {"a": at(4), "b": at(5)}}, {"abandoned-yet-returned"}),
        ({"reason": "left over"}, {"stray-abandonment"}),
        ({**OPEN, "started": {"c": {"handle": "h", "at": at(1)}}}, {"unknown-start"}),
        ({**SEALED, "started": {"a": {"handle": "h1", "at": at(1)}}}, {"sealed-with-missing-starts"}),
    ]

    def test_impossible_histories(self, spark):
        rows = [WAVE | change | {"wave": f"w{i}"} for i, (change, _) in enumerate(self.CASES)]
        found = {}
        for r in coordination.wave_problems(spark.createDataFrame(rows, KIND)).collect():
            found.setdefault(r.wave, set()).add(r.rule)
        assert {i: found.get(f"w{i}", set()) for i in range(len(rows))} == {i: rules for i, (_, rules) in enumerate(self.CASES)}

    def test_fold(self, spark):
        steps = [("start", None, "a", "h", None), ("open", ["a", "a"], None, None, None), ("open", [], None, None, None), ("open", ["a", "b"], None, None, None), ("open", ["c"], None, None, None), ("start", None, "x", "h", None), ("start", None, "a", " ", None), ("start", None, "a", "h", None), ("start", None, "a", "i", None), ("return", None, "a", None, None), ("seal", None, None, None, None), ("start", None, "b", "h", None), ("start", None, "b", "i", None), ("seal", None, None, None, None), ("return", None, "a", None, None), ("return", None, "a", None, None), ("abandon", None, None, None, ""), ("return", None, "b", None, None), ("abandon", None, None, None, "late"), ("jump", None, None, None, None)]
        events = spark.createDataFrame([("w", i, *s) for i, s in enumerate(steps)], coordination.EVENT)
        rows = coordination.fold_waves(events.repartition(3)).orderBy("seq").collect()
        assert [r.refused for r in rows] == ["unknown-wave", "duplicate-leaf", "no-leaves", None, "wave-exists", "unknown-leaf", "invalid-handle", None, "already-started", "wave-is-open", "missing-starts", "handle-in-use", None, None, None, "already-returned", "invalid-reason", None, "wave-is-complete", "unknown-action"]
        assert (rows[-1].state, rows[-1].started, rows[-1].returned) == ("complete", 2, 2)

    @pytest.mark.parametrize("seed", range(4))
    def test_admission(self, spark, seed):
        """The rounds admit what taking the claims one after the other admits."""
        import random

        rng = random.Random(seed)
        parts = ["a", "b", "c"]
        some = lambda: "/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "/*"])
        claims = [(i, f"o{i % 5}", [some() for _ in range(rng.randint(1, 2))]) for i in range(30)]
        claims += [(40, "o9", []), (41, "o9", ["../x"]), (42, "o9", ["**"])] + ([(-1, "o8", ["*"])] if seed == 3 else [])

        def overlap(x, y):
            for p, q in zip(x.split("/"), y.split("/"), strict=False):
                if "*" in p + q:
                    return True
                if p != q:
                    return False
            return True

        held, want = [], {}
        for turn, _, globs in sorted(claims):
            ok = bool(globs) and "../x" not in globs and not any(overlap(g, h) for g in globs for h in held)
            want[turn] = ok
            held += globs if ok else []
        df = spark.createDataFrame(claims, "turn long, owner string, globs array<string>")
        assert {r.turn: r.admitted for r in coordination.admit_claims(df).collect()} == want

    def test_many_claims_of_one_path(self, spark):
        """No pair of claims is made: 30,000 of one path are 450 million pairs."""
        claims = spark.range(30000).select(F.col("id").alias("turn"), F.lit("o").alias("owner"), F.array(F.lit("a/b")).alias("globs"))
        assert [r.turn for r in coordination.admit_claims(claims).filter("admitted").collect()] == [0]

    def test_targets(self, spark):
        assert coordination.resolve_target(["s"], ["f.md"]) == ("files", ["f.md"])
        assert coordination.resolve_target(["s"]) == ("scope", ["s"])
        assert coordination.resolve_target(["s", "t"], bound="t") == ("scope", ["t"])
        assert coordination.resolve_target([], legacy=["x.md"]) == ("legacy", ["x.md"])
        with pytest.raises(UsageError):
            coordination.resolve_target(["s", "t"])
        bindings = spark.createDataFrame([("1", "s"), ("2", "s"), ("2", "t")], "session string, scope string")
        assert [r.scope for s in "12" for r in coordination.session_scope(bindings, s).collect()] == ["s"]

    def test_json_state(self, spark):
        rows = [("p/1.json", '{"schema":1,"file":"a.md","gate":"G","signature":"x","approvedAt":"2024"}'), ("p/2.json", "{oops"), ("p/3.json", '{"schema":1}')]
        df = spark.createDataFrame(rows, "path string, text string")
        assert {r.path[2]: r.error for r in state.approvals(df).collect()} == {"1": None, "2": "unreadable", "3": "unreadable"}
        leases = spark.createDataFrame([("l/a.lease", '{"scope":"s","leaf":"l","globs":["./x","y/*"]}'), ("l/b.lease", "{")], "path string, text string")
        assert {tuple(r) for r in state.leases(leases).collect()} == {("s", "l", 0, "x"), ("s", "l", 1, "y/*"), ("(invalid)", "b.lease", 0, "**")}
        wave = '{"schema":1,"waves":{"w":{"leaves":["a"],"state":"open","openedAt":"2024-01-01T00:00:00Z","started":{"a":{"handle":"h","at":"2024-01-01T00:01:00Z"}},"returned":{}}}}'
        found = state.waves(spark.createDataFrame([("d", wave), ("e", "{}"), ("f", "[")], "path string, text string"))
        assert {r.path: (r.error, r.wave) for r in found.collect()} == {"d": (None, "w"), "e": ("invalid state", None), "f": ("invalid state", None)}
        assert coordination.wave_problems(found.filter("error is null")).collect() == []
        good = '{"schema":1,"sessions":{"%s":{"hash":"%s","blocks":2,"updatedAt":"2024-01-01T00:00:00Z"},"short":{"hash":"x","blocks":1,"updatedAt":"z"}}}' % ("a" * 24, "b" * 24)
        assert [(r.session, r.blocks) for r in state.sessions(spark.createDataFrame([("s", good)], "path string, text string")).collect()] == [("a" * 24, 2)]


class TestAudit:
    def review(self, spark, rows, removals=(), revision=1):
        frame = lambda data, kind: spark.createDataFrame(data, kind)
        found = audit.contract_review(
            frame([("A",), ("B",)], "id string"), frame(rows, "id string, place int, owner string, observation string, disposition string, revision int"), frame([("leaf-a",), ("leaf-b",)], "owner string"),
            frame([("GA", "A"), ("GB", "B")], "observation string, covers string"), frame([(x,) for x in removals], "id string"), revision,
        )
        return sorted((r.id, r.gap) for r in found.collect())

    def test_contract(self, spark):
        a, b = ("A", 1, "leaf-a", "GA", "ACTIVE", 1), ("B", 2, "leaf-b", "GB", "ACTIVE", 1)
        assert self.review(spark, [a, b]) == []
        assert self.review(spark, [a]) == [("B", "missing row")]
        assert self.review(spark, [a, b, ("B", 3, "leaf-b", "GB", "ACTIVE", 1)]) == [("B", "duplicate row")]
        assert self.review(spark, [a, ("B", 2, "ghost", "GA", "PARKED", 0)]) == [("B", "disposition is not completion"), ("B", "missing or stale owner"), ("B", "observation does not cover outcome"), ("B", "stale revision")]
        assert self.review(spark, [a, ("B", 2, None, None, "REMOVED_BY_USER", 1)]) == [("B", "removal lacks authority")]
        assert self.review(spark, [a, ("B", 2, None, None, "REMOVED_BY_USER", 1)], ["B"]) == []

    def test_csv_file(self, spark, tmp_path):
        kind = "ledger string, line int, id string, title string, state string, runnable boolean, check string, expect string, evidence string, approved_at string, reason string"
        gates = spark.createDataFrame([("a.md", 2, "G2", 'say "x", y', "met", True, "c", "e", "exit=0;EXPECT=matched;output-sha256=ff", "2024", None), ("a.md", 1, "G1", "t", "unmet", False, None, None, None, None, None)], kind)
        audit.write_audit_csv(audit.audit_rows(gates), str(tmp_path / "out"))
        data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
        assert data == "\ufeff" + ",".join(audit.AUDIT_COLUMNS) + '\r\na.md,G1,t,unmet,manual,,,,,,,,\r\na.md,G2,"say ""x"", y",met,runnable,c,e,0,matched,ff,,2024,\r\n'

    def test_markdown(self, spark):
        counts = spark.createDataFrame([("a|b", 1, 0, 0, 0)], "ledger string, met long, unmet long, abandoned long, manual long")
        found = spark.createDataFrame([("high", "abandoned", "G")], "severity string, code string, subject string")
        listed = spark.createDataFrame([("p", 1, "ff")], "path string, bytes long, sha256 string")
        log = spark.createDataFrame([(i, f"l{i}") for i in range(60)], "number long, text string")
        rows = audit.audit_markdown(counts, found, listed, log).orderBy("section", "place").collect()
        assert rows[0].text == "| a b | 1 | 0 | 0 | 0 |" and len(rows) == 53 and rows[-1].text == "l59"


class TestLogs:
    def test_tail_limits_patterns_and_not_lines(self, spark):
        lines = spark.createDataFrame([(i, "error" if i == 1 else "fine") for i in range(1, 11)], "number long, text string")
        whole, last = logs.LogScan(forbid=("error",), control=("fine",)), logs.LogScan(forbid=("error",), control=("fine",), tail=5, least_lines=10)
        assert logs.verdict(lines, whole).first().stage == "forbidden"
        assert tuple(logs.verdict(lines, last).first())[:2] == (10, 0)
        assert logs.verdict(lines, last).first().stage == "pass"
        with pytest.raises(UsageError):
            logs.verdict(lines.drop("number"), last)
        with pytest.raises(UsageError):
            logs.LogScan(require=("(",))


class TestDocuments:
    def test_placeholders(self, spark):
        given = ["see TODO: x", "TODOS", "</b> <name>", "작성TODO", "ooo OOO", "여기에 내용을  입력", "[[x]] {{y}}", "Lorem ipsum", "a <" + "x" * 40 + ">", ""]
        df = spark.createDataFrame(list(enumerate(given, 1)), "idx int, text string")
        found = {}
        for r in documents.placeholder_hits(df).collect():
            found.setdefault(r.idx, set()).add(r.label)
        assert {k: len(v) for k, v in found.items()} == {1: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 1}
        assert {label for label in found[3]} == {"angle bracket placeholder"}

    def test_bounds(self):
        with pytest.raises(UsageError):
            documents.SizeBounds()
        with pytest.raises(UsageError):
            documents.SizeBounds(least_words=2, most_words=1)


class TestExactSums:
    def test_digits_are_kept(self, spark):
        cells = ["0.0000004", "1" + "0" * 40, "(0.00000000000000012)", "9" * 400, "123456789012345678901234567890123.5"]
        assert column(spark, cells, numbers.parse_number) == [4e-7, 1e40, -1.2e-16, None, 123456789012345678901234567890123.5]
        assert column(spark, ["0.0000004"], lambda c: workbooks.cells_equal(c, F.lit("0"))) == [False]
        assert column(spark, [1e300, 0.5, -0.0], numbers.shown_number, "double")[1:] == ["0.5", "0"]
        million = spark.range(1_000_000).select(F.lit("0.0000004").alias("cell"))
        assert tabular.total(million, F.col("cell")).first().total == math.fsum([4e-7] * 1_000_000)

    def test_equals_fsum_in_any_layout(self, spark):
        rng = random.Random(11)
        of = lambda: rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-300, 300)
        rows = [(g, of()) for g in range(5) for _ in range(400)]
        rows += [(g, -x) for g, x in rows[:1500:3]]  # much of the largest cancels
        rows += [(5, x) for x in (5e-324, -5e-324, 5e-324, 2.0**-1022, 1.7976931348623157e308, -1.7976931348623157e308)]
        rows += [(6, 1.0), (6, 2.0**-53), (6, 2.0**-54)] + [(7, 1.7976931348623157e308)] * 2 + [(8, 0.0), (8, None)] + [(9, float("inf")), (9, 1.0), (10, float("nan")), (10, 2.0), (11, float("inf")), (11, float("-inf"))]
        rows += [(12, s * 2.0**e) for e in range(-1074, 1022) for s in (1, 1.0000000000000002, -1.9999999999999998)]
        want = {g: math.fsum(x for k, x in rows if k == g and x is not None) for g in (*range(7), 8, 12)}
        for parts in (1, 7):
            df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
            have = {r.g: (r.total, r.n) for r in tabular.exact_sums(df, F.col("x"), ["g"], {"n": F.col("x").isNotNull()}).collect()}
            assert {g: have[g][0] for g in want} == want
            assert have[7][0] == math.inf == have[9][0] and math.isnan(have[10][0]) and math.isnan(have[11][0]) and have[8][1] == 1
        assert tabular.exact_sums(df.limit(0), F.col("x")).first().total == 0.0

    def test_tiny_tolerance(self, spark):
        one = spark.createDataFrame([(1e-9, 3e-9)], "a double, b double")
        assert one.select(tabular.within(F.col("a"), F.col("b"), 1e-9).alias("x"), tabular.within(F.col("a"), F.col("b"), 2e-9).alias("y")).first() == (False, True)


class TestSortedGroups:
    ROWS = [("a", i, f"x{i % 7}:é{i}") for i in range(40)] + [(None, i, f"n{i}") for i in range(13)] + [("b", 1, None), ("c", 2, "one"), ("c", 2, "one"), ("d", 3, None), ("d", 4, "z"), ("", 5, "")]

    @pytest.mark.parametrize("batch", [1, 10_000])
    def test_digests(self, spark, batch):
        """One digest for each group, wherever batches cut it; nulls are no items, repeated ones are."""
        import hashlib

        df = spark.createDataFrame(self.ROWS, "g string, k int, item string").repartition(3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            have = {r.g: r.digest for r in audit.state_digests(df, ["g"], "item").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        groups = {g: sorted((x for h, _, x in self.ROWS if h == g and x is not None), key=str.encode) for g in {r[0] for r in self.ROWS}}
        assert have == {g: hashlib.sha256("\0".join(x).encode()).hexdigest()[:24] for g, x in groups.items()}
        assert audit.state_digests(df.limit(0), ["g"], "item").collect() == []

    def test_heads(self, spark):
        df = spark.createDataFrame(self.ROWS, "g string, k int, item string").repartition(3)
        have = {r.g: (r.n, r.shown) for r in audit.heads(df, ["g"], "k").collect()}
        assert have["a"] == (40, ", ".join(map(str, range(12))) + " +28 more") and have["c"] == (2, "2, 2") and have["b"] == (1, "1")
        assert have[None] == (13, ", ".join(map(str, range(12))) + " +1 more")

    def test_a_large_group_passes_through(self, spark):
        import hashlib

        df = spark.range(300_000).select(F.lit("g").alias("g"), F.lpad(F.col("id").cast("string"), 9, "0").alias("item"))
        want = hashlib.sha256("\0".join(f"{i:09d}" for i in range(300_000)).encode()).hexdigest()[:24]
        assert [r.digest for r in audit.state_digests(df, ["g"], "item").collect()] == [want]


class TestDecoded:
    def test_as_python_decodes(self, spark):
        """Marks, broken sequences, cp949, nothing and null, in each encoding that can be told."""
        mark = b"\xef\xbb\xbf"
        given = [b"", None, b"abc", "é日🙂".encode(), mark, mark + "é".encode(), mark + b"\xc1\xa4", "정상 end".encode("cp949"), b"a\xff", b"\xed\xa0\x80", "정상".encode(), mark + b"x" * 70_000, b"\xe6\x97"]
        df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(given)], "i int, v binary").repartition(3)
        for told in ("auto", "utf8", "cp949"):
            want = []
            for v in given:
                v = v or b""
                bom = v.startswith(mark)
                body, kind = (v[3:] if bom else v), told
                if told == "auto":
                    try:
                        body.decode()
                        kind = "utf8"
                    except UnicodeDecodeError:
                        kind = "utf8" if bom else "cp949"
                want.append((body.decode("utf-8" if kind == "utf8" else "cp949", "replace"), kind, bom))
            have = [tuple(r.d) for r in df.select("i", encoding.decoded(F.col("v"), told).alias("d")).orderBy("i").collect()]
            assert have == want, told
