"""Images as sources: validation by column expressions, and models that read them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import _c
from .models import retried

#: Bytes of an image at most.
MOST = 8 * 1024 * 1024
#: media type -> the hexadecimal digits by which its files begin (at these bytes from 0). Fixed values.
MAGIC = {"image/jpeg": [("FFD8FF", 0)], "image/png": [("89504E470D0A1A0A", 0)], "image/webp": [("52494646", 0), ("57454250", 8)]}
#: Base64: groups of four, padded at the end.
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def problem(media_type, data, most: int = MOST) -> Column:
    """Why an image isn't taken, the first of: unsupported_type, invalid_base64, empty, too_large, wrong_content; else null."""
    kind, text = F.lower(F.coalesce(_c(media_type), F.lit(""))), F.coalesce(_c(data), F.lit(""))
    ok = text.rlike(BASE64)
    content = F.when(ok, F.unbase64(text))
    starts = F
    for name, parts in MAGIC.items():
        same = F.lit(True)
        for digits, at in parts:
            same = same & (F.hex(F.substring(content, at + 1, len(digits) // 2)) == digits)
        starts = starts.when(kind == name, same)
    return (
        F.when(~kind.isin(list(MAGIC)), "unsupported_type")
        .when(~ok, "invalid_base64")
        .when(F.octet_length(content) == 0, "empty")
        .when(F.octet_length(content) > most, "too_large")
        .when(~starts.otherwise(F.lit(False)), "wrong_content")
    )


def describe(rows: DataFrame, model: Callable[[], Callable], media_type: str = "media_type", data: str = "data", question: str = "question", out: str = "found") -> DataFrame:
    """rows with problem and, for valid images, a model's JSON answer: a factory gives a function (media type, bytes, question) -> text."""
    checked = rows.withColumn("problem", problem(media_type, data))

    def run(frames):
        import base64

        one = model()
        call = retried(lambda x: one(*x))
        for frame in frames:
            found = [
                None if p is not None else call((kind, base64.b64decode(content), asked))
                for p, kind, content, asked in zip(frame["problem"].where(frame["problem"].notna(), None), frame[media_type], frame[data], frame[question])
            ]
            yield frame.assign(**{out: pd.Series(found, index=frame.index, dtype=object)})

    return checked.mapInPandas(run, StructType([*checked.schema, StructField(out, StringType())]))
