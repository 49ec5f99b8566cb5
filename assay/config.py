"""Strict options: contradictions and unknown names are refused before anything is read."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import fields


class UsageError(ValueError):
    """The request itself is wrong; nothing was measured."""


class UnusableInput(RuntimeError):
    """The input could not be measured; this is never a pass."""


def options(kind: type, **given):
    """Build the option dataclass ``kind``; unknown names are errors, as is what its own check refuses."""
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(given) - known):
        raise UsageError(f"unknown option(s): {', '.join(unknown)}")
    try:
        return kind(**given)
    except TypeError as e:
        raise UsageError(str(e)) from None


def whole(name: str, value, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise UsageError(f"{name} must be a whole number of at least {least}, not {value!r}")
    return value


def shared_folder(spark, label: str) -> str:
    """A new folder that the whole cluster sees, below ``spark.checkpoint.dir``; a single machine without one takes a
    temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise UnusableInput("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/assay-{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """``df`` with its lineage cut, in the folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset
    a single machine takes a temporary folder; a cluster shares none, so there it is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise UnusableInput("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def dealt(df, *by: str):
    """``df`` over all shuffle partitions by ``by``. Its rows are small and tell of large work, such as ranges to read: without
    a number Spark would put them together by their own size, and few tasks would do it all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
