"""Coordination state kept as JSON: approvals, leases, waves, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.paths import normalized

APPROVAL = "schema int, file string, gate string, signature string, oracle string, approvedAt string"
LEASE = "scope string, leaf string, globs array<string>"
WAVES = "schema int, waves map<string, struct<leaves: array<string>, state: string, openedAt: timestamp, sealedAt: timestamp, completedAt: timestamp, abandonedAt: timestamp, reason: string, started: map<string, struct<handle: string, at: timestamp>>, returned: map<string, struct<at: timestamp>>>>"
SESSIONS = "schema int, sessions map<string, struct<hash: string, blocks: bigint, updatedAt: string>>"


def readable(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def approvals(files: DataFrame) -> DataFrame:
    """path, ledger, id, signature, approved_at, error of files(path, text): a record that cannot be read is a row with its error."""
    r = files.select("path", F.from_json("text", APPROVAL).alias("r"), readable(F.col("text")).alias("sound"))
    whole = F.col("sound") & F.col("r.file").isNotNull() & F.col("r.gate").isNotNull()
    return r.select("path", F.col("r.file").alias("ledger"), F.col("r.gate").alias("id"), "r.signature", F.col("r.approvedAt").alias("approved_at"), F.when(~whole, "unreadable").alias("error"))


def leases(files: DataFrame) -> DataFrame:
    """scope, leaf, place, glob of files(path, text): a lease that cannot be read claims everything."""
    r = files.select("path", F.from_json("text", LEASE).alias("r"), readable(F.col("text")).alias("sound"))
    shaped = F.col("r.scope").isNotNull() & F.col("r.leaf").isNotNull() & F.col("r.globs").isNotNull()
    whole = r.filter(F.col("sound") & shaped).select("r.scope", "r.leaf", F.posexplode("r.globs").alias("place", "glob")).withColumn("glob", normalized(F.col("glob")))
    broken = r.filter(~F.col("sound")).select(F.lit("(invalid)").alias("scope"), F.element_at(F.split("path", "/"), -1).alias("leaf"), F.lit(0).alias("place"), F.lit("**").alias("glob"))
    return whole.unionByName(broken)


def waves(files: DataFrame) -> DataFrame:
    """Waves of files(path, text) in the columns of ``wave_problems``; a state of another shape gives one row with its error."""
    r = files.select("path", F.from_json("text", WAVES).alias("r"), readable(F.col("text")).alias("sound"))
    whole = F.coalesce(F.col("sound") & (F.col("r.schema") == 1) & F.col("r.waves").isNotNull(), F.lit(False))
    w = r.select("path", F.when(~whole, "invalid state").alias("error"), F.explode_outer(F.when(whole, F.col("r.waves"))).alias("wave", "w")).filter("error is not null or wave is not null")
    empty = lambda c, kind: F.coalesce(F.col(c), F.create_map().cast(kind))
    return w.select(
        "path", "error", "wave", "w.state", "w.leaves", F.col("w.openedAt").alias("opened_at"), F.col("w.sealedAt").alias("sealed_at"), F.col("w.completedAt").alias("completed_at"), F.col("w.abandonedAt").alias("abandoned_at"), "w.reason",
        empty("w.started", "map<string, struct<handle: string, at: timestamp>>").alias("started"),
        F.transform_values(empty("w.returned", "map<string, struct<at: timestamp>>"), lambda _, v: v["at"]).alias("returned"),
    )


def sessions(files: DataFrame) -> DataFrame:
    """session, hash, blocks, updated_at of the sessions that are well formed; others are dropped."""
    s = files.select(F.explode(F.from_json("text", SESSIONS)["sessions"]).alias("session", "s"))
    digest = r"^[0-9a-f]{24}\z"
    sound = F.col("session").rlike(digest) & F.coalesce(F.col("s.hash").rlike(digest) & (F.col("s.blocks") > 0) & F.try_to_timestamp("s.updatedAt").isNotNull(), F.lit(False))
    return s.filter(sound).select("session", "s.hash", "s.blocks", F.try_to_timestamp("s.updatedAt").alias("updated_at"))


def payloads(lines: DataFrame) -> DataFrame:
    """cwd, session, readable of the JSON requests of lines(text)."""
    r = F.from_json("text", "cwd string, session_id string")
    return lines.select(r["cwd"].alias("cwd"), r["session_id"].alias("session"), readable(F.col("text")).alias("readable"))


def status_lines(text: Column) -> Column:
    """The lines of a status log that are not empty."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def status_line(at: Column, event: Column) -> Column:
    """One event as one line: line ends inside it become spaces (K6)."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" "), F.regexp_replace(event, r"[\r\n]+", " "))
