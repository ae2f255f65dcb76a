"""The quality that a JPEG was saved with, from its first quantisation table."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The standard luminance table in the order that files store it.
LUMINANCE = np.array(
    """16 11 12 14 12 10 16 14 13 14 18 17 16 19 24 40 26 24 22 22 24 49 35 37 29 40 58 51 61 60 57 51 56 55 64 72 92 78 64 68 87 69 55 56 80 109
    81 87 95 98 103 104 103 62 77 113 121 112 100 120 92 101 103 99""".split(),
    int,
)
DEFAULT, LOWEST, HIGHEST = 85, 50, 95
_QUALITIES = np.arange(10, 101)
_SCALES = np.where(_QUALITIES < 50, 5000 / _QUALITIES, 200 - 2 * _QUALITIES)
TABLES = np.clip((LUMINANCE * _SCALES[:, None] + 50) // 100, 1, 255)


def quality(data: bytes) -> int:
    at = 2
    while at + 4 < len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", data, at + 2)
        if data[at + 1] == 0xDB:
            wide = data[at + 4] >> 4
            table = np.frombuffer(data, ">u2" if wide else "u1", 64, at + 5).astype(int)
            return int(np.clip(_QUALITIES[np.abs(TABLES - table).sum(1).argmin()], LOWEST, HIGHEST))
        at += 2 + size
    return DEFAULT


@F.pandas_udf(T.IntegerType())
def jpeg_quality(data: pd.Series) -> pd.Series:
    return data.map(lambda x: DEFAULT if x is None else quality(bytes(x)))
