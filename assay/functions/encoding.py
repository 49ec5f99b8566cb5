"""Encoding functions over bytes (N3-N7, P11, P12, S3). Only ``decoded`` runs Python, on what is no UTF-8: Spark has no cp949."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE, SAMPLE_LEAST, ZERO_SHARE = 512, 16, 0.2
MOJIBAKE = "\ufffd|[\u00c0-\u00ff][\u0080-\u00bf]+"  # Spark and Python read it alike


def has_bom(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == "EFBBBF"


def mojibake(text: Column) -> Column:
    """A replacement character, or a Latin-1 letter with one or more continuation-range characters after it."""
    return F.coalesce(text.rlike(MOJIBAKE), F.lit(False))


def encoding_class(content: Column) -> Column:
    """utf-16le, utf-16be, utf-16?, utf-8-bom, ascii, utf-8 or cp949-or-binary, in that order of tests.

    The sample of zero bytes is read as one character a byte, so counting and placing them are single
    passes over its 512 characters.
    """
    head = F.hex(F.substring(content, 1, 2))
    sample = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    zeros = F.length(sample) - F.length(F.replace(sample, F.lit("\0"), F.lit("")))
    many = (F.length(sample) >= SAMPLE_LEAST) & (zeros / F.length(sample) >= ZERO_SHARE)
    at_even, at_odd = sample.rlike(r"(?s)^(?:..)*?\x00"), sample.rlike(r"(?s)^.(?:..)*?\x00")
    text = content.cast("string")
    return (
        F.when(head == "FFFE", "utf-16le")
        .when(head == "FEFF", "utf-16be")
        .when(many, F.when(~at_even, "utf-16le").when(~at_odd, "utf-16be").otherwise("utf-16?"))
        .when(~F.is_valid_utf8(text), "cp949-or-binary")
        .when(has_bom(content), "utf-8-bom")
        .when(F.octet_length(content) == F.length(text), "ascii")
        .otherwise("utf-8")
    )


def mojibake_decoding(expected: str | None, label: Column) -> Column:
    """What a file is decoded as to look for mojibake: what is expected of it, else what it seems to be; null
    for UTF-16, which is not looked at (N7)."""
    own = F.when(label == "cp949-or-binary", "cp949").otherwise("utf8")
    wanted = {None: own, "utf8": F.lit("utf8"), "utf8-bom": F.lit("utf8"), "ascii": F.lit("utf8"), "cp949": F.lit("cp949")}[expected]
    return F.when(~label.startswith("utf-16"), wanted)


def bom_rule(bom: Column, label: Column, required: bool) -> Column:
    """Whether a file keeps a rule of byte order marks: that of UTF-8 must, or no mark at all may, be there."""
    return bom if required else ~bom


def meets(label: Column, expected: str, strict_cp949: bool = False) -> Column:
    """Whether a class satisfies an expectation: utf8, utf8-bom, cp949 or ascii."""
    allowed = {"utf8": ["utf-8", "utf-8-bom", "ascii"], "utf8-bom": ["utf-8-bom"], "cp949": ["cp949-or-binary"] + ([] if strict_cp949 else ["ascii"]), "ascii": ["ascii"]}
    return label.isin(allowed[expected])


def _decode(contents, wanted):
    import pandas as pd

    rows = []
    for content, want in zip(contents, wanted, strict=True):
        content = content or b""
        bom = content.startswith(b"\xef\xbb\xbf")
        body = content[3:] if bom else content
        kind = want
        if want == "auto":
            try:
                body.decode()
                kind = "utf8"
            except UnicodeDecodeError:
                kind = "utf8" if bom else "cp949"
        rows.append((body.decode("utf-8" if kind == "utf8" else "cp949", "replace"), kind, bom))
    return pd.DataFrame(rows, columns=["text", "encoding", "bom"])


def decoded(content: Column, encoding: str = "auto") -> Column:
    """Struct of text, encoding and bom (S3). The JVM decodes what is valid UTF-8, or ASCII where cp949 is told; the bytes of
    other rows alone reach Python, since the JVM has no cp949 by default."""
    raw = F.coalesce(content, F.lit(b""))
    bom = has_bom(raw)
    body = F.when(bom, F.substring(raw, 4, 2**31 - 1)).otherwise(raw)
    text = body.cast("string")
    plain = F.is_valid_utf8(text)
    if encoding == "cp949":
        plain = plain & (F.octet_length(body) == F.length(text))
    rest = F.pandas_udf(_decode, "struct<text: string, encoding: string, bom: boolean>")(F.when(~plain, raw), F.lit(encoding))
    kind = F.lit("cp949" if encoding == "cp949" else "utf8")
    return F.when(plain, F.struct(text.alias("text"), kind.alias("encoding"), bom.alias("bom"))).otherwise(rest)
