"""Base64 decoding of script text.

UTF-16LE and UTF-8 could be decoded by built-ins, but the deflate variants cannot, so one Arrow
UDF handles the few rows that hold a candidate blob; rows without one never leave the JVM.
"""

from __future__ import annotations

import base64
import re
import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from emberlog.session import ship

BLOB = r"[A-Za-z0-9+/]{40,}={0,2}"


def _texts(raw: bytes):
    for encoding in ("utf-16-le", "utf-8"):
        try:
            yield raw.decode(encoding)
        except UnicodeDecodeError:
            pass


def _candidates(blob: str):
    raw = base64.b64decode(blob + "=" * (-len(blob) % 4))
    yield from _texts(raw)
    for window in (31, -15, 15):
        try:
            yield next(_texts(zlib.decompress(raw, window)), "")
        except zlib.error:
            pass


def _decode(text: str) -> list[str]:
    found: dict[str, None] = {}
    for blob in re.findall(BLOB, text or ""):
        try:
            for s in _candidates(blob):
                if s and (s.isprintable() or any(ch.isalpha() for ch in s)):
                    found.setdefault(s)
        except ValueError:
            continue
    return list(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decode_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_decode)


def decode_base64_text(text: Column) -> Column:
    """Decoded forms of base64 runs of 40 or more characters."""
    ship(SparkSession.active())  # the workers import this module
    return F.when(text.rlike(BLOB), _decode_udf(F.when(text.rlike(BLOB), text))).otherwise(
        F.array().cast("array<string>"))
