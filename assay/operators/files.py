"""File checks over ``binaryFile`` rows (path, modificationTime, length, content): size, digest, content,
age, encoding (P6-P13, A7, A20, S1, S2)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.encoding import encoding_class, has_bom
from assay.functions.numbers import age_hours


def list_files(spark, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime and length of files, whose content is not read. Spark's reader leaves out empty files: those
    that it lists and does not give are added, without a time. Listed names are encoded as URIs, the rows' paths are not."""
    return _with_empty(_reader(spark, path, glob).select("path", "modificationTime", "length"))


def read_files(spark, path: str, glob: str | None = None) -> DataFrame:
    """Whole files (S1), empty ones as well."""
    found = _with_empty(_reader(spark, path, glob))
    return found.withColumn("content", F.coalesce("content", F.lit(b"")))


def _reader(spark, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _with_empty(found: DataFrame) -> DataFrame:
    plain = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    listed = found.sparkSession.createDataFrame([(unquote(f),) for f in found.inputFiles()], "path string").select(plain.alias("path"))
    empty = listed.join(found.select(plain.alias("path")), "path", "left_anti")
    return found.unionByName(empty.select("path", F.lit(0).cast("long").alias("length")), allowMissingColumns=True)


def size_within(length: Column, least: int | None = None, most: int | None = None) -> Column:
    ok = F.lit(True)
    ok = ok & (length >= least) if least is not None else ok
    return ok & (length <= most) if most is not None else ok


def digest_is(content: Column, sha256: str | Column) -> Column:
    """The SHA-256, in either case."""
    return F.sha2(content, 256) == F.lower(F.trim(sha256 if isinstance(sha256, Column) else F.lit(sha256)))


def has_content(text: Column) -> Column:
    """At least one line that is not white space."""
    return F.coalesce(text, F.lit("")).rlike(r"\S")


def fresh(when: Column, now: Column, hours: float) -> Column:
    return age_hours(when, now) <= hours


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def survey(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Encoding of each file; files above the ceiling are named but their content is not read."""
    small = files if not most_bytes else files.filter(F.col("length") <= most_bytes)
    seen = small.select("path", F.col("length").alias("size"), encoding_class(F.col("content")).alias("label"), has_bom(F.col("content")).alias("bom"), F.lit(False).alias("skipped"))
    if not most_bytes:
        return seen
    large = files.filter(F.col("length") > most_bytes).select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("bom"), F.lit(True).alias("skipped"))
    return seen.unionByName(large)


def consistency(labels: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct encodings other than ascii; none is ascii, more than one is inconsistent."""
    other = F.when(F.col("label") != "ascii", F.col("label"))
    kinds = F.array_sort(F.collect_set(other))
    return labels.groupBy(*by).agg(F.count_distinct(other).alias("kinds"), F.coalesce(F.nullif(F.array_join(kinds, ","), F.lit("")), F.lit("ascii")).alias("label")).withColumn("consistent", F.col("kinds") <= 1)


def newer(when: Column, other: Column) -> Column:
    """Strictly later (P10)."""
    return when > other


def file_states(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(path) against the files that were read: measured, or unusable where there is none."""
    return wanted.join(files.select("path", "length", "modificationTime"), "path", "left").select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.when(F.col("length").isNull(), "unusable").otherwise("measured").alias("state"))


def discover(files: DataFrame) -> DataFrame:
    """path, scope of ledgers below a root, in order of their path; lock folders are left out."""
    parts = F.split("path", "/")
    return files.filter(F.col("path").rlike(r"(?i)\.md\z") & ~F.array_contains(parts, "locks")).select("path", F.get(parts, F.size(parts) - 2).alias("scope")).orderBy("path")
