"""Path and glob functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.text import trimmed

WILD = r"[*?\[{]"


def normalized(path: Column) -> Column:
    """Forward slashes, without empty and dot segments."""
    raw = F.regexp_replace(F.replace(trimmed(path), F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.array_join(F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != ".")), "/")


def path_problem(path: Column, one_file: bool = False) -> Column:
    """Why a claimed path is refused, else null: blank, absolute, traversal, pattern (for single files), root."""
    raw = F.regexp_replace(F.replace(trimmed(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), r"^\./", "")
    out = F.when(raw == "", "blank").when(raw.rlike(r"^/|^[A-Za-z]:/"), "absolute").when(raw.contains("\0") | F.array_contains(F.split(raw, "/"), ".."), "traversal")
    if one_file:
        out = out.when(raw.rlike(r"[*?\[\]{}]"), "pattern")
    return out.when(normalized(raw) == "", "root")


def literal_prefix(glob: Column) -> Column:
    """The leading segments without wildcards; empty for a path that may not be claimed."""
    parts = F.when(path_problem(glob).isNull(), F.split(normalized(glob), "/")).otherwise(F.array().cast("array<string>"))
    wild = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(WILD), i)), lambda i: i.isNotNull())
    return F.array_join(F.slice(parts, F.lit(1), F.when(F.size(wild) > 0, F.array_min(wild)).otherwise(F.size(parts))), "/")


def globs_overlap(a: Column, b: Column) -> Column:
    """Disjoint only if two literal segments differ before any wildcard; a path overlaps what lies below it,
    and a path that may not be claimed overlaps everything."""
    pairs = F.arrays_zip(F.split(normalized(a), "/").alias("x"), F.split(normalized(b), "/").alias("y"))
    # 0: still equal, 1: overlap, 2: disjoint; the first decision stays
    step = lambda state, p: (
        F.when(state != 0, state)
        .when(p["x"].isNull() | p["y"].isNull() | p["x"].rlike(WILD) | p["y"].rlike(WILD), F.lit(1))
        .when(p["x"] != p["y"], F.lit(2))
        .otherwise(F.lit(0))
    )
    refused = path_problem(a).isNotNull() | path_problem(b).isNotNull()
    return refused | (F.aggregate(pairs, F.lit(0), step) != 2)


def is_inside(path: Column, root: Column) -> Column:
    return (normalized(path) == normalized(root)) | normalized(path).startswith(F.concat(normalized(root), F.lit("/")))
