"""Audit: findings over ledgers, approvals and waves, CSV rows, manifests, digests, contract review
(U1, J4, J5, J8, J14, K8-K12, A18-A21, A24)."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from assay.findings import together
from assay.functions.text import csv_cell, evidence_fields


def standing_approval(gates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Each gate with its first approval by file name; the signature plays no part."""
    first = approvals.groupBy("ledger", "id").agg(F.min_by("approved_at", "file").alias("approved_at"))
    return gates.join(first, ["ledger", "id"], "left")


def signed_approval(gates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Gates that an approval of the same signature allows to run."""
    return gates.join(approvals, ["ledger", "id", "signature"], "left_semi")


def gate_findings(gates: DataFrame) -> DataFrame:
    """Severity and code per gate with a state worth a finding; gates has approved_at."""
    code = F.when(F.col("state") == "abandoned", "abandoned").when(F.col("state") == "unmet", "unmet").when(F.col("state") == "unmet-no-evidence", "checked-without-evidence").when((F.col("state") == "met") & ~F.col("runnable"), "manual-met").when((F.col("state") == "met") & F.col("approved_at").isNull(), "met-without-standing-approval")
    severity = F.when(F.col("code").isin("abandoned", "checked-without-evidence"), "high").otherwise("medium")
    return gates.withColumn("code", code).filter("code is not null").select(severity.alias("severity"), "code", F.concat_ws(":", "ledger", "id").alias("subject"))


def orphan_approvals(approvals: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Approvals of ledgers that are gone."""
    return approvals.join(ledgers, "ledger", "left_anti").select(F.lit("low").alias("severity"), F.lit("orphan-approval").alias("code"), F.col("file").alias("subject"))


def wave_findings(waves: DataFrame) -> DataFrame:
    return waves.filter("state <> 'complete'").select(F.when(F.col("state") == "abandoned", "high").otherwise("medium").alias("severity"), F.concat(F.lit("dispatch-"), F.col("state")).alias("code"), F.col("wave").alias("subject"))


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *(csv_cell(c) for c in cells))


def state_digests(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """Per group the first 24 hex digits of the SHA-256 of its sorted items joined by NUL (A18); nulls are no items.

    Spark sorts the items within the groups and a task hashes them as they pass, so a group of any size takes the memory of
    one batch.
    """
    columns = rows.select(*by, F.col(item).cast("string").alias(item))
    schema = StructType([*columns.select(*by).schema.fields, StructField("digest", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, hashed, fed = None, None, False
        for batch in batches:
            done = []
            for *now, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashed is None or now != key:
                    if hashed is not None:
                        done.append((*key, hashed.hexdigest()[:24]))
                    key, hashed, fed = now, hashlib.sha256(), False
                if value is not None:
                    hashed.update((b"\0" if fed else b"") + value.encode())
                    fed = True
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, d, strict=True)) for d in done], arrow)
        if hashed is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*key, hashed.hexdigest()[:24]), strict=True))], arrow)

    return columns.repartition(*by).sortWithinPartitions(*by, item).mapInArrow(run, schema)


def heads(rows: DataFrame, by: list[str], item: str, n: int = 12) -> DataFrame:
    """Per group how many items there are, and the first ``n`` in order with the number left out as ``shown`` (W10). Spark
    keeps the first n of a group in each task, so no more of them meet."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(item))
    first = rows.select(*by, item).withColumn("__place", place).filter(F.col("__place") <= n)
    lists = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", F.col(item).cast("string").alias("text")))), lambda x: x["text"]).alias("__items"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") - n
    shown = F.concat(F.array_join("__items", ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return counts.alias("c").join(lists.alias("l"), same).select(*(F.col(f"c.{c}") for c in by), "n", shown.alias("shown"))


def fingerprint(text: Column) -> Column:
    """SHA-256 and UTF-8 size."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))


def bundle(report: DataFrame) -> DataFrame:
    """Each row of a report as JSON with the digest of that JSON."""
    body = F.to_json(F.struct(*report.columns))
    return report.select(body.alias("body"), F.sha2(body, 256).alias("digest"))


def contract_review(required: DataFrame, rows: DataFrame, owners: DataFrame, observations: DataFrame, removals: DataFrame, revision: int) -> DataFrame:
    """All gaps (id, gap) of required(id) against rows(id, place, owner, observation, disposition, revision).

    owners(owner) are those in office, observations(observation, covers) what each was made of, removals(id)
    what the user took out. Of several rows with one id the last by place counts and each but one is a gap.
    """
    row = F.struct("owner", "observation", "disposition", F.col("revision").alias("seen"))
    of_id = rows.groupBy("id").agg(F.max_by(row, "place").alias("row"), F.count(F.lit(1)).alias("n"))
    twice = of_id.filter("n > 1").select("id", F.explode(F.array_repeat(F.lit("duplicate row"), (F.col("n") - 1).cast("int"))).alias("gap"))
    held = required.select("id").distinct().join(of_id, "id", "left").join(removals.select("id", F.lit(True).alias("removed")).distinct(), "id", "left")
    flat = held.select("id", "removed", F.col("n").isNull().alias("lost"), "row.*")
    known = flat.join(owners.select("owner", F.lit(True).alias("in_office")).distinct(), "owner", "left")
    seen = known.join(observations.select("observation", F.lit(True).alias("observed")).distinct(), "observation", "left")
    covered = seen.join(observations.select("observation", F.col("covers").alias("id"), F.lit(True).alias("covered")).distinct(), ["observation", "id"], "left")
    no = lambda c: F.col(c).isNull()
    live = F.coalesce(F.col("disposition") != "REMOVED_BY_USER", F.lit(True))
    gaps = F.when(F.col("lost"), F.array(F.lit("missing row"))).otherwise(
        F.filter(
            F.array(
                F.when(~F.col("seen").eqNullSafe(F.lit(revision)), "stale revision"),
                F.when(~live & no("removed"), "removal lacks authority"),
                F.when(live & ~F.col("disposition").eqNullSafe(F.lit("ACTIVE")), "disposition is not completion"),
                F.when(live & no("in_office"), "missing or stale owner"),
                F.when(live & no("observed"), "missing or stale observation").when(live & no("covered"), "observation does not cover outcome"),
            ),
            lambda g: g.isNotNull(),
        )
    )
    return covered.select("id", F.explode(gaps).alias("gap")).unionByName(twice)


#: The columns of the audit table.
AUDIT_COLUMNS = ("원장", "게이트ID", "제목", "상태", "검증방식", "CHECK", "EXPECT", "종료코드", "EXPECT일치", "출력해시", "검증시각", "승인시각", "포기사유")


def audit_rows(gates: DataFrame) -> DataFrame:
    """One line of the audit table per gate, with its ledger and line for the order (K10); gates has approved_at."""
    fields = evidence_fields(F.col("evidence"))
    of = lambda key: F.try_element_at(fields, F.lit(key))
    cells = ["ledger", "id", "title", "state", F.when(F.col("runnable"), "runnable").otherwise("manual"), "check", "expect", of("exit"), of("EXPECT"), of("output-sha256"), of("verified-at"), "approved_at", "reason"]
    return gates.select("ledger", "line", csv_line(*(F.col(c) if isinstance(c, str) else c for c in cells)).alias("text"))


def write_audit_csv(rows: DataFrame, path: str, bom: bool = True) -> None:
    """The audit table as text files whose lines end in CRLF, in order over the files, header first; with a byte
    order mark unless told otherwise, as spreadsheets guess wrong without it."""
    header = ("\ufeff" if bom else "") + ",".join(AUDIT_COLUMNS)
    first = rows.sparkSession.createDataFrame([(None, None, header)], rows.schema)
    ordered = first.unionByName(rows).orderBy(F.col("ledger").asc_nulls_first(), F.col("line").asc_nulls_first())
    ordered.select("text").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def audit_markdown(counts: DataFrame, found: DataFrame, files: DataFrame, log: DataFrame, shown: int = 50) -> DataFrame:
    """Lines (section, place, text) of a report: counts(ledger, met, unmet, abandoned, manual), findings(severity,
    code, subject), manifest(path, bytes, sha256) and the last lines of log(number, text) (K11, W9)."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]", " ")
    line = lambda *columns: F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    part = lambda df, name, text, place: df.select(F.lit(name).alias("section"), place.cast("string").alias("place"), text.alias("text"))
    last = log.orderBy(F.desc("number")).limit(shown)
    return together(
        part(counts, "1 ledgers", line("ledger", "met", "unmet", "abandoned", "manual"), F.col("ledger")),
        part(found, "2 findings", line("severity", "code", "subject"), F.concat_ws(" ", "severity", "code", "subject")),
        part(files, "3 manifest", line("path", "bytes", "sha256"), F.col("path")),
        part(last, "4 log", F.col("text"), F.lpad(F.col("number").cast("string"), 20, "0")),
    )


def lint_report(warnings: DataFrame, strict: bool = False) -> DataFrame:
    """Per file its warnings as one text and the exit status: 2 where parsing failed, 1 for warnings if strict, else 0
    (K12, L1). warnings(file, id, rule)."""
    broken = F.max(F.col("rule") == "parse")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "id", "rule"))), "\n")
    status = F.when(broken, 2).otherwise(F.lit(1 if strict else 0))
    return warnings.groupBy("file").agg(F.count(F.lit(1)).alias("n"), lines.alias("text"), status.cast("int").alias("status"))


def search_path(path: Column, separator: str = ":") -> Column:
    """First 12 hex digits of a search path's SHA-256 and its number of entries that are not empty."""
    some = F.filter(F.split(path, F.lit(re.escape(separator))), lambda x: x != "")
    return F.struct(F.left(F.sha2(path, 256), F.lit(12)).alias("digest"), F.size(some).cast("long").alias("entries"))
