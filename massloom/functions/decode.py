"""Binary arrays: base64, optional zlib, little-endian floats. One Arrow batch at a time."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.errors import DecodeError
from massloom.functions import cv


def decode(text: str | None, wide: bool = True, packed: bool = False, expected: int | None = None, numpress: bool = False) -> np.ndarray:
    """The numbers of one array. White space in the text is ignored; nothing gives no numbers."""
    if numpress:
        raise DecodeError("Numpress compression is not supported")
    data = base64.b64decode("".join((text or "").split()))
    if packed and data:
        try:
            data = zlib.decompress(data)
        except zlib.error as e:
            raise DecodeError(f"zlib: {e}") from e
    width = 8 if wide else 4
    if len(data) % width:
        raise DecodeError(f"{len(data)} bytes are not a multiple of {width}")
    found = np.frombuffer(data, "<f8" if wide else "<f4").astype("f8")
    if expected is not None and len(found) != expected:
        raise DecodeError(f"{len(found)} values, expected {expected}")
    return found


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_array(text: pd.Series, wide: pd.Series, packed: pd.Series, numpress: pd.Series, expected: pd.Series) -> pd.Series:
    """decode() by column; a negative `expected` is not checked."""
    return pd.Series([decode(t, bool(w), bool(p), None if pd.isna(n) or n < 0 else int(n), bool(x)) for t, w, p, x, n in zip(text, wide, packed, numpress, expected, strict=True)])


def array_of(arrays: F.Column, expected: F.Column, *accessions: str) -> F.Column:
    """The decoded array of that role in a list of binaryDataArray structs, or null."""
    one = F.try_element_at(F.filter(arrays, lambda a: cv.has(a["cvParam"], *accessions)), F.lit(1))
    p = one["cvParam"]
    return F.when(one.isNotNull(), decode_array(one["binary"], ~cv.has(p, cv.FLOAT32), cv.has(p, cv.ZLIB), cv.has(p, *cv.NUMPRESS), F.coalesce(expected.cast("long"), F.lit(-1).cast("long"))))
