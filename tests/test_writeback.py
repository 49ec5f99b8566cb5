"""Ledgers after results, and approvals over dependency bytes."""

import pytest
from pyspark.sql import functions as F

from assay.operators import writeback
from assay.sources import ledgers

LEDGER = """# Work
- [ ] A: Totals agree
  CHECK: run a
  EXPECT: total: 1
- [x] B: Rows agree
  CHECK: run b
  EXPECT: rows: 2
    EVIDENCE: exit=0
  DEPS: in.csv
text between
- [ ] C: Names stay
  CHECK: run c
  EXPECT: names
  DEPS: in.csv
```
- [ ] A: in a fence
```
- [ ] D: by hand
"""


def digests(spark, content=b"a,b"):
    kind = "path string, content binary"
    return writeback.dep_digests(spark.createDataFrame([("in.csv", None if content is None else bytearray(content))], kind))


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def results(spark, texts, ok, evidence="exit=0; EXPECT=matched", content=b"a,b"):
    gates = writeback.met_before(ledgers.parse(files(spark, texts)).gates)
    signed = writeback.signed_gates(gates, digests(spark, content))
    given = spark.createDataFrame(list(ok.items()), "id string, ok boolean")
    return signed.join(given, "id").select("file", "id", "signature", "ok", "was_met", F.lit(evidence).alias("evidence"))


def written(spark, now, found, content=b"a,b"):
    df = files(spark, now)
    out = writeback.write_back(df, ledgers.parse(df), found, digests(spark, content))
    return {r.file: r.text for r in out.texts.collect()}, {r.id: r.outcome for r in out.outcomes.collect()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_change_alone(spark, end):
    text = LEDGER.replace("\n", end)
    texts, told = written(spark, {"f": text, "other": text}, results(spark, {"f": text}, {"A": True, "B": False, "C": True, "D": False}))
    want = text.replace("- [ ] A: Totals", "- [x] A: Totals").replace(f"total: 1{end}", f"total: 1{end}  EVIDENCE: exit=0; EXPECT=matched{end}")
    want = want.replace("- [x] B", "- [ ] B").replace(f"    EVIDENCE: exit=0{end}", f"    EVIDENCE: pending{end}")
    want = want.replace("- [ ] C", "- [x] C").replace(f"EXPECT: names{end}", f"EXPECT: names{end}  EVIDENCE: exit=0; EXPECT=matched{end}")
    assert texts == {"f": want}
    assert told == {"A": "met", "B": "unmet", "C": "met", "D": "unchanged"}
    states = {r.id: (r.state, r.evidence) for r in ledgers.parse(files(spark, texts)).gates.collect()}
    assert states["A"] == ("met", "exit=0; EXPECT=matched") and states["B"][0] == "unmet" and states["C"][0] == "met"


def test_stale_results_change_nothing(spark):
    found = results(spark, {"f": LEDGER}, {"A": True, "B": False, "C": True})
    now = LEDGER.replace("run a", "run all").replace("- [ ] C: Names stay", "- [ ] C2: Names stay")
    texts, told = written(spark, {"f": now}, found, content=b"a,c")
    assert texts == {} and told == {"A": "stale", "B": "stale", "C": "stale"}


def test_invalid_ledger_and_no_results(spark):
    found = results(spark, {"f": LEDGER}, {"A": True})
    texts, told = written(spark, {"f": LEDGER + "- [ ] A: again\n"}, found)
    assert texts == {} and told == {"A": "invalid"}
    assert written(spark, {"f": LEDGER, "empty": ""}, found.limit(0)) == ({}, {})


def test_repeated_results(spark):
    found = results(spark, {"f": LEDGER}, {"A": True, "B": True})
    texts, told = written(spark, {"f": LEDGER}, found.union(found).union(found.filter("id = 'A'").withColumn("ok", F.lit(False))))
    assert told == {"A": "unchanged", "B": "met"}
    assert texts == {"f": LEDGER.replace("    EVIDENCE: exit=0", "    EVIDENCE: exit=0; EXPECT=matched")}


def test_one_byte_of_a_dependency_voids_an_approval(spark):
    gates = ledgers.parse(files(spark, {"f": LEDGER})).gates
    given = writeback.signed_gates(gates, digests(spark), shell="sh")
    state = lambda content, shell="sh": {r.id: r.approval for r in writeback.approval_states(writeback.signed_gates(gates, digests(spark, content), shell=shell), given).collect()}
    assert set(state(b"a,b").values()) == {"approved"}
    assert state(b"a,c") == {"A": "approved", "B": "refused", "C": "refused", "D": "approved"}
    assert state(None) == {"A": "approved", "B": "blocked", "C": "blocked", "D": "approved"}
    assert set(state(b"a,b", "zsh").values()) == {"refused"}


def test_order_of_dependencies_and_bytes_that_are_no_text(spark):
    kind = "file string, id string, line int, check string, expect string, cwd string, deps array<string>"
    rows = [("f", "A", 1, "run", "x", None, ["p", "q"]), ("f", "B", 2, "run", "x", None, ["q", "p"]), ("f", "C", 3, "run", "x", None, []), ("f", "D", 4, "run", "x", None, None), ("f", "A", 1, "run", "x", None, ["p", "q"])]
    sign = lambda p: [(r.id, r.signature) for r in writeback.signed_gates(spark.createDataFrame(rows, kind), writeback.dep_digests(spark.createDataFrame([("p", bytearray(p)), ("q", bytearray(b"q"))], "path string, content binary"))).orderBy("id").collect()]
    one, other = sign(b"\xff"), sign(b"\xfe")
    assert len(one) == 5 and one[0] == one[1] and dict(one)["A"] != dict(one)["B"] and dict(one)["C"] == dict(one)["D"]
    assert [a == b for a, b in zip(one, other, strict=True)] == [False, False, False, True, True]


def test_texts_are_parsed_once(spark):
    """The rules read lines and gates that are written; none goes back to the texts."""
    plan = ledgers.parse(files(spark, {"f": LEDGER})).problems._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the patterns of expectations


def test_gates_without_dependencies_stay_in_their_tasks(spark):
    kind = "file string, id string, line int, check string, expect string, cwd string, deps array<string>"
    gates = spark.createDataFrame([("f", str(i), i, "run", "x", None, None) for i in range(100)], kind).repartition(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = writeback.signed_gates(gates, digests(spark))
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
